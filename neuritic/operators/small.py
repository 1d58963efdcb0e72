"""Cells of a bounded size, many of them at once, inside tasks: what forest does by doubling across the cluster, on arrays.

Spark deals whole cells to tasks and sorts them; a task holds about HELD nodes at a time. Cells of more than SMALL nodes never come here,
nor do those that lack a number. The steps are those of forest, so results don't depend on the way that a cell takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed

#: Nodes up to which a cell may be held by one task, and nodes of whole cells that a task holds at a time.
SMALL, HELD = 50_000, 100_000


def parts(rows: DataFrame, odd: Column | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cells that a task may hold, and of all others, None if there are none. odd: rows whose cells are among the others;
    most: rows up to which a task may hold a cell, SMALL by default."""
    most = SMALL if most is None else min(most, SMALL)
    sizes = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(False) if odd is None else odd).alias("odd"))
    others = checkpointed(sizes.filter((F.col("n") > most) | F.col("odd")).select("cell_id"))
    if others.isEmpty():
        return rows, None
    return rows.join(others, "cell_id", "left_anti"), rows.join(others, "cell_id", "left_semi")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by cell, those of a cell one after another."""
    return rows.repartition("cell_id").sortWithinPartitions("cell_id")


def whole_cells(run: Callable[[pa.Table], pa.Table], held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What run makes of tables of whole cells, from the batches of a task of dealt(); held: rows of whole cells at a time."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= held:
                t = pa.Table.from_batches(kept)
                first = n - pc.sum(pc.equal(t["cell_id"], t["cell_id"][-1])).as_py()  # of the last cell, which may go on
                if first:
                    yield from run(t.slice(0, first).combine_chunks()).to_batches(max_chunksize=10_000)
                kept, n = t.slice(first).to_batches(), n - first
        if n:
            yield from run(pa.Table.from_batches(kept).combine_chunks()).to_batches(max_chunksize=10_000)

    return tables


def by_cells(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """What run makes of tables of whole cells, rows of a cell one after another."""
    return dealt(rows).mapInArrow(whole_cells(run, HELD), schema)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column of numbers, to be written to; 0 where there is none."""
    c = t[name]
    return np.array(pc.fill_null(c, pa.scalar(0, c.type)).to_numpy())


def there(t: pa.Table, name: str) -> np.ndarray:
    return t[name].is_valid().to_numpy()


def codes(t: pa.Table) -> np.ndarray:
    """Numbers of the cells, from 0."""
    c = t["cell_id"]
    return np.concatenate(([0], np.cumsum(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()))).astype(np.int64)


def places(code: np.ndarray, ids: np.ndarray, wanted: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Where the wanted id of the same cell stands, -1 where it isn't there or none is given."""
    known, rank = np.unique(ids, return_inverse=True)
    key = code * len(known) + rank
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    pos = np.minimum(np.searchsorted(key[order], code * len(known) + at), len(key) - 1)
    found = given & (known[at] == wanted) & (key[order][pos] == code * len(known) + at)
    return np.where(found, order[pos], -1)


def picked(t: pa.Table, name: str, at: np.ndarray) -> pa.ChunkedArray:
    """Values of other rows, null where the place is -1."""
    return t[name].take(pa.array(at, mask=at < 0))


def doubled(up: np.ndarray, adds: list[tuple[np.ndarray, np.ndarray]], firsts: list[np.ndarray]) -> np.ndarray:
    """Adds up numbers on the way to the root and looks for the nearest place, in place; returns what was reached from a root. See forest.lift().
    adds: numbers and whether they are there."""
    anc, before = up.copy(), None
    while (left := int((anc >= 0).sum())) and left != before:
        before = left
        for _ in range(2):
            m = np.flatnonzero(anc >= 0)
            a = anc[m]
            for x, given in adds:
                x[m] = np.where(given[m], x[m] + x[a], 0)
            for f in firsts:
                f[m] = np.where(f[m] >= 0, f[m], f[a])
            anc[m] = anc[a]
    return anc < 0


def lift(state: DataFrame, adds: list[str], firsts: list[str]) -> DataFrame:
    """forest.lift() for small cells; whoever is on a cycle keeps its ancestor."""

    def run(t: pa.Table) -> pa.Table:
        up = places(codes(t), numbers(t, "id"), numbers(t, "anc"), there(t, "anc"))
        sums = [(numbers(t, c), there(t, c)) for c in adds]
        nearest = [np.where(there(t, c), np.arange(len(up)), -1) for c in firsts]
        reached = doubled(up, sums, nearest)
        out = {"cell_id": t["cell_id"], "id": t["id"], "anc": picked(t, "anc", np.where(reached, -1, np.arange(len(up))))}
        out |= {c: pa.array(x, type=t[c].type, mask=~given) for c, (x, given) in zip(adds, sums, strict=True)}
        return pa.table(out | {c: picked(t, c, f) for c, f in zip(firsts, nearest, strict=True)})

    rows = state.select("cell_id", "id", "anc", *adds, *firsts)
    return by_cells(rows, run, rows.schema)


def topology(nodes: DataFrame) -> DataFrame:
    """forest.topology() for small cells."""
    kind, rest = dict(nodes.dtypes), [c for c in nodes.columns if c not in ("cell_id", "id")]
    more = {"px": kind["x"], "py": kind["y"], "pz": kind["z"], "parent_radius": kind["radius"], "is_root": "boolean", "edge": "double", "n_children": "bigint"}
    more |= {"proxy": kind["id"], "sx": kind["x"], "sy": kind["y"], "sz": kind["z"], "soma_radius": kind["radius"], "parent_children": "bigint"}
    more |= {"path": "double", "depth": "int", "branch_order": "int", "primary_root": kind["id"], "head": kind["id"], "root": kind["id"], "reached": "boolean", "pos": "int", "path_in_branch": "double"}

    def run(t: pa.Table) -> pa.Table:
        code, ids = codes(t), numbers(t, "id")
        order = np.lexsort((numbers(t, "seq"), ids, code))  # the last row of each id counts
        last = np.append((np.diff(code[order]) != 0) | (np.diff(ids[order]) != 0), True)
        t, code, ids = t.take(pa.array(order[last])).combine_chunks(), code[order[last]], ids[order[last]]
        n = len(ids)
        up = places(code, ids, numbers(t, "parent"), there(t, "parent"))
        child, own = up >= 0, np.arange(n)
        x, y, z, radius, seq = (numbers(t, c) for c in ("x", "y", "z", "radius", "seq"))
        edge = np.where(child, np.sqrt((x - x[up]) ** 2 + (y - y[up]) ** 2 + (z - z[up]) ** 2), 0.0)
        kids = np.bincount(up[child], minlength=n)
        roots = np.flatnonzero(~child)
        roots = roots[np.lexsort((-seq[roots].astype(np.int64), kids[roots], radius[roots], code[roots]))]
        best = np.full(code[-1] + 1, -1)
        best[code[roots]] = roots  # the last one of each cell stays
        proxy, above = best[code], np.where(child, kids[up], 0)
        primary, fork = child & (up == proxy), child & (above > 1)
        path, depth, branch_order = edge.copy(), child.astype(np.int32), fork.astype(np.int32)
        primary_root, head, root = (np.where(is_one, own, -1) for is_one in (primary, primary | fork, ~child))
        every = np.ones(n, dtype=bool)
        reached = doubled(up, [(path, every), (depth, every), (branch_order, every)], [primary_root, head, root])
        for v in (path, depth, branch_order):
            v[~reached] = 0
        for f in (primary_root, head, root):
            f[~reached] = -1
        out = {c: t[c] for c in ("cell_id", "id", *rest)} | {c: picked(t, of, up) for c, of in (("px", "x"), ("py", "y"), ("pz", "z"), ("parent_radius", "radius"))}
        out |= {"is_root": ~child, "edge": edge, "n_children": kids} | {c: picked(t, of, proxy) for c, of in (("proxy", "id"), ("sx", "x"), ("sy", "y"), ("sz", "z"), ("soma_radius", "radius"))}
        out |= {"parent_children": pa.array(above, mask=~child), "path": path, "depth": depth, "branch_order": branch_order} | {c: picked(t, "id", f) for c, f in (("primary_root", primary_root), ("head", head), ("root", root))}
        return pa.table(out | {"reached": reached, "pos": pa.array(depth - depth[head], mask=head < 0), "path_in_branch": pa.array(path - path[head], mask=head < 0)})

    return by_cells(nodes, run, ", ".join(f"`{c}` {k}" for c, k in {"cell_id": kind["cell_id"], "id": kind["id"], **{c: kind[c] for c in rest}, **more}.items()))


def below(state: DataFrame) -> DataFrame:
    """The doubling of forest.subtree_stats() for small cells, with path and seq in place of far_tip."""
    sums, schema = ("size", "forks", "tips", "cable"), "id {id}, size long, forks long, tips long, cable double, max_path double, max_depth int, first_fork double, min_radius {r}, far_tip {id}"
    kind = dict(state.dtypes)

    def run(t: pa.Table) -> pa.Table:
        up = places(codes(t), numbers(t, "id"), numbers(t, "anc"), there(t, "anc"))
        n, own = len(up), np.arange(len(up))
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((numbers(t, "id"), -numbers(t, "seq").astype(np.int64), numbers(t, "path")))] = own
        tip = np.argsort(rank)
        step, v = numbers(t, "far"), {c: numbers(t, c) for c in (*sums, "max_path", "max_depth", "min_radius")}
        fork = np.where(there(t, "first_fork"), numbers(t, "first_fork"), np.inf)
        anc, far, hops = up.copy(), step.copy(), np.ones(n, dtype=np.int32)
        while len(m := np.flatnonzero(anc >= 0)):
            a = anc[m]
            new = {c: x.copy() for c, x in v.items()}
            for c in sums:
                np.add.at(new[c], a, v[c][m] + (step[m] if c == "cable" else 0))
            np.maximum.at(new["max_path"], a, v["max_path"][m] + far[m])
            np.maximum.at(new["max_depth"], a, v["max_depth"][m] + hops[m])
            np.minimum.at(new["min_radius"], a, v["min_radius"][m])
            new_fork, new_rank = fork.copy(), rank.copy()
            np.minimum.at(new_fork, a, fork[m] + far[m])
            np.maximum.at(new_rank, a, rank[m])
            v, fork, rank = new, new_fork, new_rank
            far[m], hops[m] = far[m] + far[a], hops[m] + hops[a]
            anc[m] = anc[a]
        out = {"cell_id": t["cell_id"], "id": t["id"], **v, "first_fork": pa.array(fork, mask=np.isinf(fork)), "far_tip": t["id"].take(pa.array(tip[rank]))}
        return pa.table({c: out[c] for c in ("cell_id", "id", *sums, "max_path", "max_depth", "first_fork", "min_radius", "far_tip")})

    return by_cells(state, run, f"cell_id {kind['cell_id']}, " + schema.format(id=kind["id"], r=kind["min_radius"]))


def smooth(rows: DataFrame, rounds: int, parent_weight: float, child_weight: float, threshold: float, allowed: list[str]) -> DataFrame:
    """rules.smooth() for small cells. allowed: columns that say whether labels 2, 3 and 4 may win; they are left out of the result."""

    def run(t: pa.Table) -> pa.Table:
        ids, own, pred, conf = np.arange(len(t)), numbers(t, "id"), numbers(t, "pred"), numbers(t, "conf").astype(float)
        up = places(codes(t), own, numbers(t, "parent"), there(t, "parent"))
        votes = there(t, "proxy") & (own != numbers(t, "proxy"))
        asked = votes & there(t, "pred") & there(t, "conf") & (conf < threshold)
        heard, child, may = (up >= 0) & votes[up], ids[(up >= 0) & votes], [numbers(t, c) for c in allowed]
        for _ in range(rounds):
            v = []
            for k, ok in zip((2, 3, 4), may, strict=True):
                kids = np.bincount(up[child[pred[child] == k]], minlength=len(t))
                v.append(np.where(ok > 0, np.where(pred == k, conf, 0.0) + np.where(heard & (pred[up] == k), parent_weight, 0.0) + child_weight * kids, -1.0))
            best = np.where((v[0] >= v[1]) & (v[0] >= v[2]), 2, np.where(v[1] >= v[2], 3, 4))
            pred = np.where(asked & (pred != 1), best, pred)
        out = t.drop_columns(allowed)
        return out.set_column(out.column_names.index("pred"), "pred", pa.array(pred, mask=~there(t, "pred")).cast(t["pred"].type))

    return by_cells(rows, run, rows.drop(*allowed).schema)
