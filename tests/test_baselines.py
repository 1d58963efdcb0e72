"""Several predictors in one run, with errors kept as rows."""

from neuritic.operators import forest, metrics
from neuritic.plans import baselines
from neuritic.session import checkpointed

SCHEMA = "cell_id string, cell_type string, seq int, id long, type int, x double, y double, z double, radius double, parent long"


def cells(spark):
    rows = []
    for c in range(6):
        size = 40 if c == 5 else 12
        rows += [(f"c{c}", "pyramidal" if c % 2 else "interneuron", k, k + 1, 1 if k == 0 else 2 + (k + c) % 2, float(k), 0.0, float(k * c), 5.0 if k == 0 else 1.0, -1 if k == 0 else max(1, k - 2)) for k in range(size)]
    return checkpointed(forest.topology(spark.createDataFrame(rows, SCHEMA)))


def test_all_methods_in_one_table(spark):
    topo = cells(spark)

    def picky(cell):
        if cell["cell_id"].iloc[0] == "c1":
            raise KeyError("nothing known")
        if cell["cell_id"].iloc[0] == "c2":
            return [2]
        assert "type" not in cell.columns and cell["seq"].is_monotonic_increasing
        return [1, *[3] * (len(cell) - 1)]

    methods = baselines.standard(checkpointed(metrics.prior(topo))) | {"picky": baselines.per_cell(picky, most=20)}
    rows = baselines.run(topo, methods).cache()
    got = {(r.method, r.cell_id): r for r in rows.collect()}
    assert len(got) == 5 * 6
    errors = {c: got["picky", c].error for c in ("c0", "c1", "c2", "c3", "c4", "c5")}
    assert errors == {"c0": None, "c1": "KeyError: 'nothing known'", "c2": "ValueError: 1 labels for 12 nodes", "c3": None, "c4": None, "c5": "too large: 40 nodes"}
    assert all((r.error is None) == (r.neurite_macro_f1 is not None) for r in got.values())
    truth = {c: [r.type for r in topo.filter(f"cell_id = '{c}'").orderBy("id").collect()] for c in ("c0", "c3")}
    for c, of in truth.items():
        right = sum(t == (1 if k == 0 else 3) for k, t in enumerate(of))
        assert abs(got["picky", c].accuracy - right / len(of)) < 1e-12
    table = baselines.table(rows).collect()
    assert {r.method: (r.n_files, r.n_errors) for r in table} == dict.fromkeys(["random", "majority", "heuristic", "chain"], (6, 0)) | {"picky": (3, 3)}
    assert [r.neurite_macro_f1 for r in table] == sorted((r.neurite_macro_f1 for r in table), reverse=True)


def test_no_cells(spark):
    topo = cells(spark).limit(0)
    assert baselines.run(topo, {"plug": baselines.per_cell(lambda cell: cell["id"])}).count() == 0


def test_a_cell_of_any_size_is_labelled(spark):
    n = 200_001
    topo = spark.range(n).selectExpr("'big' AS cell_id", "id AS seq", "id + 1 AS id", "CAST(NULLIF(id, 0) AS INT) AS parent", "id / 2 AS x")
    said = baselines.per_cell(lambda cell: cell["id"] % 3 + 2)(topo)
    assert said.selectExpr("count(*)", "count(error)", "count_if(pred = id % 3 + 2)", "count(DISTINCT id)").first()[:] == (n, 0, n, n)


def test_large_cells_come_as_small_ones_do(spark, monkeypatch):
    from neuritic.operators import small

    def plug_in(cell):
        if cell["cell_id"].iloc[0] == "c3":
            raise KeyError(f"{len(cell)}")
        if cell["cell_id"].iloc[0] == "c4":
            return [2] * (len(cell) - 1)
        return [(sum(map(len, cell.dtypes.astype(str))) + int(k) + int(x) + (0 if p != p else int(p))) % 1000 for k, x, p in zip(cell["seq"], cell["x"], cell["primary_root"])]

    topo = cells(spark)
    ask = lambda: sorted(map(tuple, baselines.per_cell(plug_in)(topo).collect()), key=str)
    want = ask()
    monkeypatch.setattr(small, "SMALL", 5)
    assert ask() == want and len(want) == 40 + 3 * 12 + 2
