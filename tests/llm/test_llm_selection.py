"""Hard negatives, whitening and exact deduplication against brute force, and on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from neuritic.llm import exact_dedup, hard_negatives, language_id, media, mixing, token_store, whitening

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ hard negatives
def brute_negatives(rows, k=5):
    """Sorted result rows from (vec_id, vector, label)."""
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int), (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v, _ in kept]).reshape(len(kept), width)
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
    out = []
    for a, (i, _, lab) in enumerate(kept):
        if i is None or i % 100:
            continue
        score = x @ x[a]
        for p, pid in first([(int(score[c]), kept[c][0]) for c in range(len(kept)) if c != a and kept[c][2] == lab]):
            wanted = first([(int(score[c]), kept[c][0]) for c in range(len(kept)) if kept[c][2] != lab and 80 * p <= 100 * score[c] <= 100 * p])
            out += [(i, pid, rank, nid, p, s) for rank, (s, nid) in enumerate(wanted, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, w int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, label=label, **settings).collect()
    return sorted((tuple(r) for r in got), key=str)


def tied_rows(n=700, seed=1):
    """A third of the rows share a vector and an id; nulls, short vectors and ids of all 64 bits besides."""
    rng = random.Random(seed)
    base = [[rng.choice([0.0, 0.01, 0.02, 0.5]) for _ in range(3)] for _ in range(6)]
    out = []
    for _ in range(n):
        if rng.random() < 0.33:
            out.append((300, base[0], 1))
            continue
        i = rng.choice([None, 100, 200, 7, -(1 << 63), (1 << 63) - 1, rng.randrange(-50, 400), rng.randrange(-(1 << 62), 1 << 62)])
        v = rng.choice([*base, base[1][:2], [], None, [float("nan"), 1.0, 1.0], [None, 1.0, 1.0]])
        out.append((i, v, rng.choice([None, 0, 1, 1, 2])))
    return out


def test_hard_negatives_of_tied_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FEW", 1)  # all digits of ids are refined
    rows = tied_rows(300)
    assert mined(spark, rows, group_rows=80, window_rows=60) == brute_negatives(rows)


def test_hard_negatives_of_wide_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(0, 10.0 ** rng.integers(0, 4), 5)], int(rng.integers(0, 10))) for k in range(0, 900, 3)]
    got = mined(spark, rows, group_rows=64, window_rows=16)
    assert got == brute_negatives(rows) and len(got) > 20


def test_hard_negatives_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1), (200, [1.0], None)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(100, [1e12], 1), (200, [1e12], 1)])


def test_hard_negatives_hand_on_few_rows(spark):
    """Histograms and k rows per window and task leave a task, whatever the number of copies."""
    rows = [(100, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)] + [(k, [0.9, 0.0], 1) for k in range(2, 2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = []
    run = hard_negatives.Selection._run

    def counted(self, *args):
        out = run(self, *args).persist()
        made.append(out.count())
        return out

    try:
        hard_negatives.Selection._run = counted
        got = hard_negatives.hard_negatives(df, is_anchor=F.col("vec_id") == 100, group_rows=500).collect()
    finally:
        hard_negatives.Selection._run = run
    assert [r.negative_id for r in sorted(got, key=lambda r: r["rank"])] == [2, 3, 4, 5, 6]
    assert max(made) <= 256 * 4 and made[-1] <= 5 * 4


# ------------------------------------------------------------------ whitening
def whitened(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component string")
    return whitening.whiten(df, **settings).toPandas()


def check_whitening(got, x, k):
    """Values against a dense eigendecomposition."""
    n = len(x)
    z = x - x.mean(axis=0)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    want = z @ u / np.sqrt(e)
    w = got.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == want.shape and np.abs(np.abs(w) - np.abs(want)).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), e / z.var(axis=0).sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    whole = x.astype(int) + 1_000_000
    assert got.groupby("vec_id").deviation.first().tolist() == ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1).tolist()
    assert (got.n == n).all()


def test_whitening_equals_eigenvectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(vectors.embedding).astype(float))
    check_whitening(whitening.op12_embedding_whitening(spark, SF).toPandas(), x, 32)


def test_whitening_iterates_with_a_narrow_block(spark):
    rng = np.random.default_rng(1)
    x = np.floor(64 * rng.standard_normal((400, 60)) * np.r_[np.linspace(9, 4, 6), np.full(54, 0.2)])
    rows = [(k, (v / 64).tolist()) for k, v in enumerate(x)]
    check_whitening(whitened(spark, rows, k=6, block=8), x, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    numbers = whitening.whole_numbers(df)
    of = whitening.centre(numbers)
    basis = whitening.components(numbers, of, 6, block=8)
    assert len(basis.residuals) > 2 and set(basis.widths) == {8} and basis.residuals[-1] <= 1e-13


def test_whitening_widens_its_block_on_a_flat_spectrum(spark):
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.standard_normal((500, 40)))
    df = spark.createDataFrame([(k, (v / 64).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    numbers = whitening.whole_numbers(df)
    basis = whitening.components(numbers, whitening.centre(numbers), 5, block=6)
    assert basis.widths[-1] == 40 and basis.residuals[-1] <= 1e-13


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    good = [(None if k % 5 == 0 else k // 3, rng.standard_normal(4).tolist()) for k in range(60)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 4), (903, [float("inf")] * 4)]
    got = whitened(spark, good + bad + [(904, [1.0])], k=32)
    assert len(got) == 61 * 4 and set(got.component) == {1, 2, 3, 4} and (got.n == 61).all() and got.identity_error[0] < 1e-9
    assert len(whitened(spark, [])) == len(whitened(spark, [(1, [1.0, 2.0])])) == len(whitened(spark, [(k, [1.0, 2.0]) for k in range(9)])) == len(whitened(spark, [(1, []), (2, [])])) == 0
    flat = whitened(spark, [(k, [float(k), 1.0, 2.0 * k]) for k in range(9)])
    assert set(flat.component) == {1} and abs(flat.explained[0] - 1) < 1e-12


def test_deviation_beyond_64_bits_is_null():
    of = whitening.Centre(4, 1, 1 << 40, (0,), (0,), (0,))
    assert of.deviations(np.array([[1 << 20], [1 << 40]])) == [(4 << 20) ** 2, None]


# ------------------------------------------------------------------ exact deduplication
def brute_classes(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), {(keep, sha) for _, keep, _, sha in out}


def held_against(spark, texts, **settings):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, ref string, n int")
    got = exact_dedup.deduplicate(df.repartition(4), **settings).collect()
    want, classes = brute_classes(texts)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.sha.hex()) for r in got), key=str) == want
    stay = [(r.doc_id, r.sha.hex()) for r in got if r.kept]
    assert len(stay) == len(set(stay)) and set(stay) == classes
    assert len({r["class"] for r in got}) == len(classes)


def many_texts():
    rng = random.Random(4)
    texts = [(k, rng.choice(["Same TEXT " * 50, "same text " * 50, f"text {rng.randrange(60)} " * rng.randrange(1, 30), "", None, "ÄÖ É", "äö é", " x", "x"])) for k in range(500)]
    return texts + texts[:40] + [(None, "no id"), (None, "No id"), (None, "text 1 "), (5, "same text " * 50)] + [(9000 + k, "long " * 60_000) for k in range(3)]


@pytest.mark.parametrize("settings", [{}, {"held": 3000, "target": 500, "limit": 2000, "first": 2}])
def test_exact_dedup(spark, settings):
    held_against(spark, many_texts(), **settings)


def test_exact_dedup_of_a_third_in_one_group(spark):
    """Copies in more tasks than a bucket holds are merged in parts; no table gets them all."""
    texts = [(k, "Copy " * 40 if k % 3 == 0 else f"own {k}") for k in range(1200)]
    held_against(spark, texts, held=300, target=300, limit=1000, first=4)


def test_exact_dedup_empty(spark):
    held_against(spark, [])
    held_against(spark, [(None, None)])


def test_content_table_compares_contents():
    """Equal digests don't make equal contents."""
    t = exact_dedup.ContentTable(4)
    digest = b"\0" * 32
    assert [t.number(digest, c) for c in (b"a", b"b", b"a", b"c", b"b", b"d", b"e")] == [0, 1, 0, 2, 1, 3, 4]
    assert [t.number(bytes([k]) * 32, str(k).encode()) for k in range(1, 100)] == list(range(5, 104))


def test_queries_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for module in (hard_negatives, exact_dedup):
        for name, query in module.QUERIES.items():
            got, want = query(spark, SF).toPandas(), con.sql(module.ORACLE[name]).df()
            by = sorted(want.columns)
            assert len(want) > 0 and got[by].astype(str).sort_values(by).values.tolist() == want[by].astype(str).sort_values(by).values.tolist()


# ------------------------------------------------------------------ media files follow from their texts
def test_equal_texts_have_equal_files(spark):
    """Whatever is written beside them, and in whatever order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    seen = defaultdict(set)
    for n in (1, 4, 9):
        for turn in (1, -1):
            dealt = docs.repartition(n, F.xxhash64(F.lit(n), "doc_id")).sortWithinPartitions(F.col("doc_id") * turn)
            for r in media.features(media.store(dealt)).collect():
                seen[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) > 100


# ------------------------------------------------------------------ ids that are null or repeated
def test_mixing_meets_targets_on_null_ids(spark):
    rows = [(None, f"{'word ' * 20}{k}", "a") for k in range(1500)] + [(k, f"{'other ' * 30}{k}", "b") for k in range(1500)]
    got = mixing.op7_columns(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most


def test_languages_are_learned_from_a_bounded_sample(spark, monkeypatch):
    """Rows with one id, and copies, don't add to what is drawn."""
    rng = random.Random(1)
    words = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows = [(None, words(), "en") for _ in range(2000)] + [(7, words(), "de")] * 1500 + [(k, words(), "de") for k in range(100)]
    seen = []
    monkeypatch.setattr(language_id, "fit_model", lambda langs, x, families: seen.append((langs, x)))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50)
    (langs, x), = seen
    assert len(x) == len(langs) and 20 < langs.count("en") < 90 and 20 < langs.count("de") < 90


def test_token_store_deals_one_id_to_many_tasks(spark):
    rows = [(5, f"text {k} of one id") for k in range(3000)] + [(None, f"text {k} without") for k in range(1000)] + [(k, "x") for k in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so little data together
    try:
        written = token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(len(r.doc_ids) for r in written.select("doc_ids").collect()) < 2000
    got = token_store.read(written).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
