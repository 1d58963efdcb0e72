"""Language-model scores from a hidden Markov model.

Words fall into classes by a hash of their last letters. Latent states emit classes, and a class emits its words by
their smoothed counts in the whole training corpus: P(text) = P(classes | model) * product of P(word | class). The
first factor is exact, by the scaled forward recursion over the whole text. States are trained by Baum-Welch: one sweep over all
training documents in `slices` parts, after each of which the states are told anew, then rounds that take expected counts over all
of them. Spark adds the counts up; what returns to the driver is a table of states x classes. No document counts more than another.

Word counts cover the whole corpus. Tasks number the distinct words of blocks of documents and keep documents as
such numbers; only the blocks' dictionaries meet in a shuffle by word, and the words' counts, a table of its own, are joined
back to the blocks, so that Spark can split a word that stands in very many blocks.

Results in corner cases: null and empty texts hold the end token only; without training documents every count is 0;
repeated rows are documents each; null ids are treated as the empty text by the split; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, drop_stored, pick, stored, table

STATES = 8
#: Class 0 is the end of a document.
CLASSES = 4096
#: Bytes of text whose words share a dictionary.
BLOCK_BYTES = 12 << 20
#: Tokens whose forward and backward variables are held at once, unless one document has more.
HELD_TOKENS = 1 << 19
#: Tokens of documents that a task sorts by length at once.
SORTED_TOKENS = 1 << 22


@dataclass
class Model:
    """pi: states. a: from state x to state. e: class x state."""

    pi: np.ndarray
    a: np.ndarray
    e: np.ndarray

    @staticmethod
    def random(states: int = STATES, classes: int = CLASSES, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        stay = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
        e = rng.gamma(1.0, 1.0, (classes, states)) + 0.2
        return Model(np.full(states, 1 / states), stay, e / e.sum(axis=0))

    @staticmethod
    def from_counts(first: np.ndarray, step: np.ndarray, emit: np.ndarray, smooth: float = 0.01) -> Model:
        """A state's unseen classes share `smooth` counts each, scaled by how common the class is."""
        share = (emit.sum(axis=1) + 0.5) / (emit.sum() + 0.5 * len(emit))
        e = emit + smooth * len(emit) * share[:, None]
        first, step = first + 0.1, step + 0.1
        return Model(first / first.sum(), step / step.sum(axis=1, keepdims=True), e / e.sum(axis=0))


class Lanes:
    """Sequences side by side, longest first, in time order: at time t the first size[t] lanes run."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        lens = np.array([len(seqs[i]) for i in self.order])
        self.size = len(lens) - np.searchsorted(lens[::-1], np.arange(1, lens[0] + 1)) if len(lens) else np.zeros(0, dtype=int)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.obs = np.empty(self.at[-1], dtype=np.int32)
        for lane, i in enumerate(self.order):
            self.obs[self.at[: len(seqs[i])] + lane] = seqs[i]

    def _alphas(self, m: Model, emits: np.ndarray, alphas: np.ndarray | None = None) -> np.ndarray:
        """The scale of each observation, and its forward variables where alphas is given. emits: m.e of each observation."""
        scales, alpha, at, a = np.empty(len(self.obs)), m.pi, self.at.tolist(), m.a
        for t, n in enumerate(self.size.tolist()):
            lo, hi = at[t], at[t + 1]
            alpha = (alpha[:n] @ a if t else alpha) * emits[lo:hi]
            c = np.add.reduce(alpha, axis=1, out=scales[lo:hi])
            alpha /= c[:, None]
            if alphas is not None:
                alphas[lo:hi] = alpha
        return scales

    def forward(self, m: Model) -> np.ndarray:
        """Natural logarithm of the probability of each sequence, in the order given."""
        lane = np.arange(len(self.obs)) - np.repeat(self.at[:-1], self.size)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(lane, np.log(self._alphas(m, m.e[self.obs])), len(out))
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, of steps between states, and of classes by state."""
        k = len(m.pi)
        gamma, emits = np.empty((len(self.obs), k), dtype=np.float32), m.e[self.obs]
        scale, at, back = self._alphas(m, emits, gamma)[:, None], self.at.tolist(), m.a.T
        step, behind = np.zeros((k, k)), np.zeros((0, k))
        for t in range(len(self.size) - 1, -1, -1):
            lo, hi, more = at[t], at[t + 1], len(behind)
            beta = behind @ back
            if more < hi - lo:  # lanes that end here
                beta = np.concatenate((beta, np.ones((hi - lo - more, k))))
            if more:
                step += gamma[lo : lo + more].T @ behind
            behind = emits[lo:hi]  # of no use after this step
            behind *= beta
            behind /= scale[lo:hi]
            gamma[lo:hi] *= beta
        emit = np.stack([np.bincount(self.obs, gamma[:, s], len(m.e)) for s in range(k)], axis=1)
        first = gamma[: self.size[0]].sum(axis=0, dtype=float) if len(self.size) else np.zeros(k)
        return first, step * m.a, emit


def batched(seqs: list[np.ndarray], held: int = HELD_TOKENS) -> Iterator[tuple[np.ndarray, Lanes]]:
    """Sequences of like length together, so many that their variables fit."""
    order = np.argsort([len(s) for s in seqs], kind="stable")
    group, n = [], 0
    for i in order:
        if group and n + len(seqs[i]) > held:
            yield np.array(group), Lanes([seqs[j] for j in group])
            group, n = [], 0
        group.append(i)
        n += len(seqs[i])
    if group:
        yield np.array(group), Lanes([seqs[j] for j in group])


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("seq", pa.binary()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a document as numbers of words, and a word of the block's dictionary with its training count."""
    from pyspark import TaskContext

    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    held: list[tuple[int | None, bool]] = []
    seqs: list[np.ndarray] = []
    place: dict[bytes, int] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(place), dtype=np.int64)
        for s, (_, out) in zip(seqs, held, strict=True):
            if not out:
                k, times = np.unique(s, return_counts=True)
                n[k] += times
        docs, none = len(held), pa.nulls
        for lo in range(0, docs, 500):
            part = held[lo : lo + 500]
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * k, pa.int64()), pa.array([i for i, _ in part], pa.int64()), pa.array([o for _, o in part]), pa.array([_pack(s) for s in seqs[lo : lo + 500]], pa.binary()), none(k, pa.int32()), none(k, pa.binary()), none(k, pa.int64())],
                schema=_ROWS,
            )
        words = iter(place)
        for lo in range(0, len(place), 20_000):
            part = list(islice(words, 20_000))
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, block)), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.binary()), pa.array(np.arange(lo, lo + k, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(n[lo : lo + k])],
                schema=_ROWS,
            )

    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "held_out", "bytes")]
        for k in range(batch.num_rows):
            i, out, text = (c[k].as_py() for c in columns)
            words = text.lower().split()
            new = set(words).difference(place)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            seqs.append(np.fromiter(map(place.__getitem__, words), dtype=np.uint32, count=len(words)))
            held.append((i, out))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from flush()
                held, seqs, place, size, block = [], [], {}, 0, block + 1
    if held:
        yield from flush()


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Documents' classes, so many documents at once that sorting them by length pays."""
    seqs, n = [], 0
    for pdf in batches:
        for b in pdf["classes"]:
            seqs.append(_unpack(b, "<u2"))
            n += len(seqs[-1])
            if n >= SORTED_TOKENS:
                yield seqs
                seqs, n = [], 0
    if seqs:
        yield seqs


def expected(known: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes.expected() over all documents."""
    shared = known.sparkSession.sparkContext.broadcast(m)  # states x classes numbers

    k, classes = len(m.pi), len(m.e)
    states = [f"s{s}" for s in range(k)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, sums = shared.value, None
        for _, lanes in (b for seqs in _portions(batches) for b in batched(seqs)):
            first, step, emit = lanes.expected(m)
            got = np.concatenate([first[None], step, emit])
            sums = got if sums is None else sums + got
        if sums is not None:  # in fixed point, so that sums don't depend on their order
            units = np.rint(sums * (1 << 20)).astype(np.int64)
            some = np.flatnonzero(units.any(axis=1))
            yield pd.DataFrame(units[some], columns=states).assign(cell=some)

    # a row for each class, not for each class and state
    got = known.select("classes").mapInPandas(count, ", ".join(f"{s} long" for s in states) + ", cell long").groupBy("cell").agg(*(F.sum(s).alias(s) for s in states)).toPandas()
    sums = np.zeros((1 + k + classes, k))
    sums[got["cell"]] = got[states] / (1 << 20)
    return sums[0], sums[1 : 1 + k], sums[1 + k :]


def train(known: DataFrame, rounds: int = 3, slices: int = 16) -> Model:
    """Baum-Welch over documents given as doc_id, n_tokens and packed classes."""
    m, sums = Model.random(), None
    # a slice goes to a quarter of the tasks, as lanes side by side take a step for each token of the longest document
    tasks = -(-known.rdd.getNumPartitions() // 4)
    for k in range(slices):
        got = expected(known.filter(F.pmod(F.xxhash64("doc_id", "classes"), F.lit(slices)) == k).coalesce(tasks), m)
        if got[0].any():  # what earlier states expected fades
            sums = got if sums is None else tuple(a / 2 + b for a, b in zip(sums, got, strict=True))
            m = Model.from_counts(*sums)
    for _ in range(rounds if sums else 0):
        m = Model.from_counts(*expected(known, m))
    return m


def score(docs: DataFrame, rounds: int = 3, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; see op5's contract.

    model: states to score with; by default they are trained.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 7) == 2).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes")
    )
    rows = stored(docs.mapInArrow(_numbered, "block long, doc_id long, held_out boolean, seq binary, place int, word binary, n long"), "words")
    suffix = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(CLASSES - 1)) + 1
    totals = rows.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    totals = stored(totals.select("word", "c", suffix.cast("int").alias("class")), "counts")
    per_class = totals.groupBy("class").agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("words")).toPandas()
    ends = rows.filter("word IS NULL AND NOT held_out").count()
    c_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    c_class[per_class["class"]], v_class[per_class["class"]] = per_class["tokens"], per_class["words"]
    n_train, v_train = int(c_class.sum()) + ends, int(v_class.sum()) + (ends > 0)

    def look_up(d: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        c, cls = np.zeros(len(w) + 1, dtype=np.int64), np.zeros(len(w) + 1, dtype=np.uint16)
        c[w["place"]], cls[w["place"]] = w["c"], w["class"]
        c[-1] = ends  # the end token
        base = np.log10((c + 1) / (n_train + v_train + 1))
        word = np.log10((c + 1) / (c_class[cls] + v_class[cls] + 1))
        word[-1] = 0.0  # the only one of its class
        known = c > 0
        out = {"n_tokens": [], "n_known": [], "base_score": [], "word_score": [], "classes": []}
        for b in d["seq"]:
            s = np.append(_unpack(b, "<u4").astype(np.int64), len(w))
            out["n_tokens"].append(len(s))
            out["n_known"].append(int(known[s].sum()))
            out["base_score"].append(float(base[s].sum()))
            out["word_score"].append(float(word[s].sum()))
            out["classes"].append(_pack(cls[s].astype("<u2")))
        return pd.DataFrame({"doc_id": d["doc_id"].astype("Int64").to_numpy(), "held_out": d["held_out"].to_numpy(dtype=bool), **out})

    left = rows.filter("word IS NULL").select("block", "doc_id", "held_out", "seq").groupBy("block")
    right = rows.filter("word IS NOT NULL").select("block", "place", "word").join(totals, "word").select(F.col("block").alias("b"), "place", "c", "class").groupBy("b")
    known = stored(left.cogroup(right).applyInPandas(look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, classes binary"), "known")
    drop_stored(rows)
    drop_stored(totals)
    model = spark.sparkContext.broadcast(model or train(known.filter("NOT held_out"), rounds))

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def scored() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            seqs = [_unpack(b, "<u2") for b in pdf["classes"]]
            logs = np.zeros(len(seqs))
            for rows, lanes in batched(seqs):
                logs[rows] = lanes.forward(model.value)
            pdf["score"] = logs / np.log(10) + pdf["word_score"]
            return pdf.drop(columns=["classes", "word_score"])

        for pdf in batches:
            held.append(pdf)
            n += int(pdf["n_tokens"].sum())
            if n >= SORTED_TOKENS:
                yield scored()
                held, n = [], 0
        if held:
            yield scored()

    out = known.mapInPandas(forward, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op5_hmm_score": op5_hmm_score}
ORACLE = {}
