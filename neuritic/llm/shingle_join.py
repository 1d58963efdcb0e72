"""Jaccard self-join of documents over word 5-grams by the chosen-path method.

A document is the set of its distinct word n-grams. Documents with equal sets form a class, and one set of each
class takes part. Each run of the join picks shared tokens at random: at a node of the path tree a set keeps those
of its tokens whose hash, salted by the path, is below 1 / (threshold * size), so two sets that are similar enough
keep a common token with probability 1 - 1/e at least, and land in the same bucket. Buckets of up to `limit` sets are
compared by brute force; larger ones are split again by second tokens, sampled `AGAIN` times for each bucket; where that
saves no pairs, as among near copies, the bucket stays whole. What is still larger is compared block by block, so that
no bucket is cut short. Runs repeat until a pair at the threshold is missed with probability
of at most 1 - recall. A pair that meets in several buckets counts in the one with the smallest path only, which both
sets can tell from their lists of buckets, so pairs are never written out to remove duplicates: each bucket
reports, for each set, the number of its similar partners and one edge to the smallest set that its links connect it with
there, so all sets that the bucket's links connect stay connected.

Similarity is exact: intersections of the whole sets are compared in integers.

Results in corner cases: texts that are null or without words are similar to nothing (n_links 0, a class each);
texts of fewer than five words have one n-gram, the whole text; very long texts are read in windows; repeated rows are
copies of each other; null ids are ids like others, but for class_id and group_id, the smallest ids, which pass over them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, drop_stored, pick, stored, table
from .components import components

U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=U)
_STEP = U(0x9E3779B97F4A7C15)
_STEP_INVERSE = U(pow(int(_STEP), -1, 1 << 64))
_GRAM = _RNG.integers(0, 1 << 63, 64, dtype=U) << U(1) | U(1)
COORDINATES = 64
_MUL = _RNG.integers(0, 1 << 63, (COORDINATES, 1), dtype=U) << U(1) | U(1)
_ADD = _RNG.integers(0, 1 << 64, (COORDINATES, 1), dtype=U)
_POW = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
#: Sketches of sets at the threshold agree in fewer coordinates with a probability of about 3 in a million.
AGREE_AT = 4.9
#: Bytes of text after which words are cut off and hashed.
WINDOW = 1 << 22
#: How often a large bucket is split by second tokens.
AGAIN = 4
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            p = np.full(size, step, dtype=U)
            p[0] = U(1)
            _POW[k] = np.cumprod(p, dtype=U)
    return _POW[0][:n], _POW[1][:n]


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text; words are compared in lower case."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    parts, at = [np.zeros(0, dtype=U)], 0
    while at < len(raw):
        end = _SPACE.search(raw, at + WINDOW)
        end = end.start() if end else len(raw)
        parts.append(_words(raw[at:end]))
        at = end
    word = np.concatenate(parts) if len(parts) != 2 else parts[1]
    if not len(word):
        return word
    if len(word) < n:
        return _mix(np.array([(word * _GRAM[: len(word)]).sum(dtype=U) + U(len(word))], dtype=U))
    size = len(word) - n + 1
    gram = np.zeros(size, dtype=U)
    for k in range(n):
        gram += word[k : k + size] * _GRAM[k]
    return np.unique(_mix(gram))


def _words(raw: bytes) -> np.ndarray:
    """A hash of each word, the same wherever the word stands."""
    b = np.frombuffer(raw, dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=U)
    power, inverse = _powers(len(b) + 1)
    run = np.concatenate((np.zeros(1, dtype=U), np.cumsum((_TABLE[b] | U(1)) * power[:-1], dtype=U)))
    return _mix((run[end] - run[start]) * inverse[start] + (end - start).astype(U))


def _sketch(s: np.ndarray) -> bytes:
    low = np.full((COORDINATES, 1), np.iinfo(U).max, dtype=U)
    for lo in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, lo : lo + 4096] * _MUL + _ADD).min(axis=1, keepdims=True))
    return (_mix(low[:, 0]) >> U(48)).astype(np.uint16).tobytes()


def _chosen(s: np.ndarray, salts: np.ndarray, threshold: float) -> np.ndarray:
    """Child paths of a set at nodes with these salts."""
    bar = U(min((1 << 64) - 1, int((1 << 64) / (threshold * len(s)))))
    u = _mix(s[None, :] ^ _mix(salts)[:, None])
    node, token = np.nonzero(u < bar)
    return np.unique(_mix(u[node, token] * _STEP + salts[node]))


def _again(path: int) -> np.ndarray:
    """Salts by which a large bucket is split; a pair at the threshold is parted by all of them with a probability of exp(-AGAIN)."""
    return _mix(np.int64(path).view(U) + np.arange(1, AGAIN + 1, dtype=U) * _STEP)


def runs_needed(recall: float, levels: int) -> int:
    """Runs after which a pair at the threshold, split at every level, is missed with probability 1 - recall at most."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000, heavy: str | None = None) -> Iterator[pd.DataFrame]:
    """Batches of whole groups; the input is sorted by keys. 32 kB of the column heavy count as a row more."""
    held: list[pd.DataFrame] = []
    n = 0

    def weight(pdf: pd.DataFrame) -> int:
        return len(pdf) + (int(pdf[heavy].map(len).sum()) >> 15 if heavy else 0)
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += weight(pdf)
        if n < rows:
            continue
        pdf = pd.concat(held, ignore_index=True)
        new = np.flatnonzero((pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1))
        if len(new):
            yield pdf.iloc[: new[-1] + 1]
            pdf = pdf.iloc[new[-1] + 1 :]
        held, n = [pdf], weight(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(pdf: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, group's first row) of rows of a group whose sketches agree and of which this is the first common bucket."""
    keys = pdf[["path", "a", "b"]].to_numpy()
    first = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(pdf)]))
    sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint16).reshape(-1, COORDINATES)
    n, half = pdf["n"].to_numpy(), pdf["half"].to_numpy()
    cross = (pdf["a"] != pdf["b"]).to_numpy()
    path = pdf["path"].to_numpy()
    need = COORDINATES * threshold - AGREE_AT * math.sqrt(COORDINATES * threshold * (1 - threshold))
    width = max(map(len, pdf["leaves"]))
    leaves = np.full((len(pdf), width), np.iinfo(np.int64).max, dtype=np.int64)
    for k, x in enumerate(pdf["leaves"]):
        leaves[k, : len(x)] = x

    def check(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (~cross[i] | (half[i] != half[j]))
        i, j = i[near], j[near]
        same = (sketch[i] == sketch[j]).sum(axis=1) >= need
        i, j = i[same], j[same]
        kept = []
        for lo in range(0, len(i), 20_000):
            x, y = leaves[i[lo : lo + 20_000]], leaves[j[lo : lo + 20_000]]
            here = path[i[lo : lo + 20_000]]
            earlier = np.zeros(len(x), dtype=bool)
            for c in range(width):
                v = x[:, c]
                if not (v < here).any():
                    break
                earlier |= (v < here) & (y == v[:, None]).any(axis=1)
            kept.append(~earlier)
        kept = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
        return i[kept], j[kept]

    size = np.diff(first)
    for s in np.unique(size):
        if s < 2:
            continue
        starts = first[:-1][size == s]
        i0, j0 = np.triu_indices(s, 1)
        step = max(1, 100_000 // len(i0))
        for lo in range(0, len(starts), step):
            at = starts[lo : lo + step]
            for plo in range(0, len(i0), 200_000):
                i = (at[:, None] + i0[None, plo : plo + 200_000]).ravel()
                j = (at[:, None] + j0[None, plo : plo + 200_000]).ravel()
                i, j = check(i, j)
                if len(i):
                    yield i, j, first[np.searchsorted(first, i, side="right") - 1]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, by products of incidence matrices over the elements of two or more."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, col = owner[keep], number[code[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(col, [lo, lo + 2048])
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def similar(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, levels: int = 2, limit: int = 1024, group: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with the same n-grams), n_copies (documents of the class),
    n_links (other documents at least as similar as the threshold), group_id (smallest id connected by links); and what a
    caller needs to keep one document of each group: text_hash, cls (the class), n (its n-grams), first_class (of the group's classes it
    is the first)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    temporary: list[DataFrame] = []

    def held(df: DataFrame, label: str) -> DataFrame:
        temporary.append(stored(df, label))
        return temporary[-1]

    salts = _mix(np.arange(1, runs_needed(recall, levels) + 1, dtype=U))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, n) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "text_hash": pdf["text_hash"],
                "cls": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "n": [len(s) for s in sets],
                "sketch": [_sketch(s) if len(s) else b"" for s in sets],
                "paths": [_chosen(s, salts, threshold).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64) for s in sets],
            })

    read_from = docs.withColumn("text_hash", F.xxhash64("text"))
    sets = held(read_from.mapInPandas(read, "doc_id long, text_hash long, cls binary, n long, sketch binary, paths array<long>"), "sets")
    reps = held(
        sets.filter("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("own"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        .withColumns({"class_id": F.col("own.doc_id"), "class_text": F.col("own.text_hash")}).drop("own"),
        "classes",
    )

    def shared(members: DataFrame) -> DataFrame:
        """Rows (cls, path) of paths that two sets or more have, with their number."""
        sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        # written first: a join whose sides are both read afresh is one that Spark can split where a path is in very many sets
        return held(members.join(held(sizes, "sizes"), "path"), "buckets")

    def texts_of(classes: DataFrame) -> DataFrame:
        """The n-grams of these classes, read again from the text of one document of each."""

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [shingles(t, n) for t in pdf["text"]]
                yield pd.DataFrame({"cls": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in got], "grams": [s.tobytes() for s in got]})

        ids = reps.join(classes.select("cls").distinct(), "cls", "left_semi").select(F.col("class_id").alias("_id"), F.col("class_text").alias("_text"))
        found = read_from.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text")), "left_semi")
        return found.mapInPandas(again, "cls binary, grams binary").dropDuplicates(["cls"])  # rows may be repeated

    def in_blocks(members: DataFrame) -> DataFrame:
        return members.select("cls", "path", F.ceil(F.col("size") / limit).cast("int").alias("blocks"))

    buckets = shared(reps.select("cls", F.explode("paths").alias("path")))
    leaves = [buckets.filter(F.col("size") <= limit).select("cls", "path", F.lit(1).alias("blocks"))]
    big = buckets.filter(F.col("size") > limit)
    for _ in range(levels - 1):
        if big.isEmpty():
            break

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for c, g, at in zip(pdf["cls"], pdf["grams"], pdf["paths"], strict=True):
                    s = np.frombuffer(g, dtype=U)
                    rows += [(c, p, q) for q in at for p in _chosen(s, _again(q), threshold).view(np.int64)]
                if rows:
                    yield pd.DataFrame({"cls": [r[0] for r in rows], "path": np.array([r[1] for r in rows], dtype=np.int64), "parent": np.array([r[2] for r in rows], dtype=np.int64)})

        at = big.groupBy("cls").agg(F.collect_set("path").alias("paths"))
        parts = shared(texts_of(big).join(at, "cls").mapInPandas(split, "cls binary, path long, parent long"))
        # of near copies the parts hold about as many pairs as the bucket or more
        pairs = big.groupBy("path").agg((F.first("size") * (F.first("size") - 1)).alias("pairs"))
        inside = parts.groupBy("parent").agg(F.sum(F.col("size") - 1).alias("inside"))
        whole = held(inside.join(pairs, F.col("parent") == F.col("path")).filter("inside >= pairs").select("parent"), "whole")
        leaves.append(in_blocks(big.join(whole, F.col("path") == F.col("parent"), "left_semi")))
        buckets = parts.join(whole, "parent", "left_anti")
        leaves.append(buckets.filter(F.col("size") <= limit).select("cls", "path", F.lit(1).alias("blocks")))
        big = buckets.filter(F.col("size") > limit).select("cls", "path", "size")
    leaves.append(in_blocks(big))
    member = reduce(DataFrame.unionByName, leaves)
    lists = member.groupBy("cls").agg(F.array_sort(F.collect_set("path")).alias("leaves"))
    known = held(reps.join(lists, "cls").select("cls", "n", "n_copies", "sketch", "leaves"), "members")
    half = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    member = member.select("cls", "path", half.alias("half"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    member = member.select("cls", "path", "half", F.least("half", "other").alias("a"), F.greatest("half", "other").alias("b"))
    keys = ["path", "a", "b"]

    def taking_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, keys):
            part = np.zeros(len(pdf), dtype=bool)
            for i, j, _ in _candidates(pdf, threshold):
                part[i] = part[j] = True
            if part.any():
                yield pdf.loc[part, ["cls", "path", "half", "a", "b"]]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    part = held(dealt(member.join(known, "cls")).mapInPandas(taking_part, "cls binary, path long, half int, a int, b int"), "parts")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, keys, 2_000, "grams"):
            links, docs_linked = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            size, copies, cls = pdf["n"].to_numpy(), pdf["n_copies"].to_numpy(), pdf["cls"].to_numpy()
            low = cls.copy()
            for g, lo, hi, pairs in _by_group(pdf, threshold):
                common = _common([np.frombuffer(x, dtype=U) for x in g])
                root = np.arange(len(g))
                for i, j in pairs:
                    both = common[i - lo, j - lo]
                    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
                    i, j = i[ok], j[ok]
                    np.add.at(links, i, 1)
                    np.add.at(links, j, 1)
                    np.add.at(docs_linked, i, copies[j])
                    np.add.at(docs_linked, j, copies[i])
                    _join(root, i - lo, j - lo)
                least = low[lo : hi + 1].copy()
                np.minimum.at(least, root, cls[lo : hi + 1])
                low[lo : hi + 1] = least[root]
            keep = links > 0
            if keep.any():
                yield pd.DataFrame({"cls": cls[keep], "links": links[keep], "docs": docs_linked[keep], "low": low[keep]})

    found = dealt(part.join(known, "cls").join(texts_of(part), "cls")).mapInPandas(verified, "cls binary, links long, docs long, low binary")
    found = held(found, "links")
    total = found.groupBy("cls").agg(F.sum("docs").alias("docs"))
    of_class = reps.select("cls", "class_id", "n_copies").join(total, "cls", "left")
    cols = [
        "doc_id",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
    ]
    if group:
        roots = components(found.select("cls", "low"), "cls", "low").withColumnRenamed("node", "cls")
        ids = roots.join(reps.select("cls", "class_id"), "cls")
        smallest = ids.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min(F.struct(F.col("class_id").isNull(), "class_id", "cls")).alias("first"))
        temporary.append(roots)
        of_class = of_class.join(roots.join(smallest, "root").select("cls", "group_id", (F.col("first.cls") == F.col("cls")).alias("first_class")), "cls", "left")
        cols.append(F.when(F.col("n") > 0, F.coalesce("group_id", "class_id")).otherwise(F.col("doc_id")).alias("group_id"))
        cols += ["text_hash", "cls", "n", F.coalesce("first_class", F.lit(True)).alias("first_class")]
    out = sets.select("doc_id", "text_hash", "cls", "n").join(held(of_class, "of-class"), "cls", "left")
    out = stored(out.select(*cols), "similar")
    for used in temporary:
        drop_stored(used)
    return out


def _by_group(pdf: pd.DataFrame, threshold: float) -> Iterator[tuple[list[bytes], int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each group with candidates: its sets, its first and last row, and the candidate pairs as rows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, j, first in _candidates(pdf, threshold):
        cuts = np.flatnonzero(np.diff(first)) + 1
        for x, y, f in zip(np.split(i, cuts), np.split(j, cuts), np.split(first, cuts), strict=True):
            held.setdefault(int(f[0]), []).append((x, y))
    grams = pdf["grams"].to_numpy()
    for lo, pairs in held.items():
        hi = max(int(j.max()) for _, j in pairs)
        yield list(grams[lo : hi + 1]), lo, hi, pairs


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """root[x], the smallest row that x is connected with, after these pairs are added; before any pair it is x itself."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_copies", "n_links", "group_id")


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLE = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM w
), c AS (
  SELECT row_number() OVER () AS cid, g, min(doc_id) AS class_id, count(*) AS n_copies FROM s WHERE len(g) > 0 GROUP BY g
), e AS (SELECT cid, len(g) AS k, unnest(g) AS t FROM c
), l AS (
  SELECT a.cid AS a, b.cid AS b FROM e a JOIN e b ON a.t = b.t AND a.cid <> b.cid GROUP BY a.cid, b.cid, a.k, b.k HAVING 9 * count(*) >= 4 * (a.k + b.k)
), n AS (SELECT l.a AS cid, sum(c.n_copies) AS links FROM l JOIN c ON c.cid = l.b GROUP BY 1
), r AS (SELECT cid, cid AS m FROM c UNION SELECT r.cid, l.b FROM r JOIN l ON l.a = r.m
), g AS (SELECT r.cid, min(c.class_id) AS group_id FROM r JOIN c ON c.cid = r.m GROUP BY 1)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, CAST(coalesce(c.n_copies, 1) AS BIGINT) AS n_copies,
  CAST(coalesce(c.n_copies, 1) - 1 + coalesce(n.links, 0) AS BIGINT) AS n_links, coalesce(g.group_id, s.doc_id) AS group_id
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN n ON n.cid = c.cid LEFT JOIN g ON g.cid = c.cid
"""
}
