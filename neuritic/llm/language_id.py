"""Language identification by hierarchical discrimination.

A linear support vector machine over hashed character n-grams first names the language family; then one-versus-one
machines tell the languages of that family apart. Machines are fitted on a bounded sample of labelled documents
(`per_lang` of each language and `most` in all, drawn by a hash of the id, whole texts); prediction covers every whole text.

Results in corner cases: a text that is null, empty or has no letter gives `und` with score 0; if no labelled
document may be learned from, every text gives `und`; repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, pick, table

UND = "und"
#: Families of common languages by their two-letter codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa"),
    "semitic": ("ar", "he", "mt", "am"),
}
DIM_BITS = 13
DIM = 1 << DIM_BITS
#: Every byte below 128 that isn't a letter becomes a space, so junk symbols and digits carry no weight.
_LATIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
#: A text is read in windows of so many bytes, each overlapping the last by two, so that memory is bounded.
WINDOW = 1 << 20


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the byte bigrams and trigrams of a whole lower-cased text; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_LATIN), dtype=np.uint8)
    total = np.zeros(DIM, dtype=np.float64)
    for lo in range(0, len(raw), WINDOW):
        b = raw[lo : lo + WINDOW + 2].astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        keep = two != 0x2020
        three = two[:-1] << np.uint32(8) | b[2:]
        three = three[keep[:-1] & keep[1:]]
        if lo + WINDOW + 2 < len(raw):  # the last bigram here is the next window's first
            two, keep = two[:-1], keep[:-1]
        for grams in (two[keep], three):
            total += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return total


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of each n-gram: a vector of length one, whatever the length of the text."""
    c = counts(text)
    if c is None or not c.any():
        return None
    return np.sqrt(c / c.sum()).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = (x * x).sum(1)
    caps = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), caps[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic function that turns a margin into a probability; at least 1."""
    s = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(s * margin * y, -30, 30)))
        grad, curve = ((1 - p) * margin * y).sum() - 0.01 * s, (p * (1 - p) * margin * margin).sum() + 0.01
        s = float(np.clip(s + grad / curve, 1.0, 20.0))
    return s


@dataclass
class Model:
    """families: names and one machine each, one against the rest. pairs: for each family its languages and machines."""

    families: list[str] = field(default_factory=list)
    family_w: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1)))
    family_slope: list[float] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    pair_w: dict[str, np.ndarray] = field(default_factory=dict)
    pair_slope: dict[str, list[float]] = field(default_factory=dict)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for t in texts:
            v = vector(t) if self.families else None
            if v is None:
                langs.append(UND)
                scores.append(0.0)
                continue
            family, p = self._best(v, self.families, self.family_w, self.family_slope, None)
            names = self.langs[family]
            lang, q = self._best(v, names, self.pair_w[family], self.pair_slope[family], list(combinations(range(len(names)), 2)))
            langs.append(lang)
            scores.append(min(1.0, max(0.0, p * q)))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    @staticmethod
    def _best(v: np.ndarray, names: list[str], w: np.ndarray, slope: list[float], pairs: list[tuple[int, int]] | None) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        p = 1 / (1 + np.exp(-np.clip((w[:, :-1] @ v + w[:, -1]) * slope, -30, 30)))
        if pairs is None:
            p = p / p.sum()
            k = int(p.argmax())
            return names[k], float(p[k])
        votes, belief = np.zeros(len(names)), np.zeros(len(names))
        for (a, b), x in zip(pairs, p, strict=True):
            votes[a if x >= 0.5 else b] += 1
            belief[a] += x
            belief[b] += 1 - x
        k = max(range(len(names)), key=lambda i: (votes[i], belief[i], -i))
        return names[k], float(belief[k] / (len(names) - 1))


def fit_model(langs: list[str], x: np.ndarray, families: dict[str, tuple[str, ...]]) -> Model:
    """The machines for labelled vectors."""
    home = {lang: f for f, own in families.items() for lang in own}
    y = np.array([home.get(lang, lang) for lang in langs], dtype=object)
    m = Model(families=sorted(set(y)))
    tell = np.array(langs, dtype=object)

    def machine(rows: np.ndarray, sign: np.ndarray, ws: list, slopes: list) -> None:
        w = fit_svm(x[rows], sign)
        ws.append(w)
        slopes.append(fit_slope(x[rows] @ w[:-1] + w[-1], sign))

    if len(m.families) > 1:
        ws: list = []
        for f in m.families:
            machine(np.arange(len(x)), np.where(y == f, 1.0, -1.0), ws, m.family_slope)
        m.family_w = np.array(ws)
    for f in m.families:
        m.langs[f] = sorted(set(tell[y == f]))
        ws, m.pair_slope[f] = [], []
        for a, b in combinations(m.langs[f], 2):
            rows = np.nonzero((tell == a) | (tell == b))[0]
            machine(rows, np.where(tell[rows] == a, 1.0, -1.0), ws, m.pair_slope[f])
        m.pair_w[f] = np.array(ws)
    return m


def train(docs: DataFrame, per_lang: int = 400, most: int = 20_000, families: dict[str, tuple[str, ...]] | None = None, learn: Column | None = None) -> Model:
    """Fits on about per_lang documents of each language and `most` in all (the documented bounds), of those with lang and
    text where learn holds.

    Which ones is told by a hash of the text, at a rate that the number of different texts of the language gives; each text is
    drawn once, so neither null or repeated ids nor copies add to what the driver gets.
    """
    known = pick(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        known = known.filter(learn)
    known = known.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    per_lang = min(per_lang, most / len(sizes))
    rates = F.create_map(*(F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, per_lang / n))))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30)).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(int(i), lang, v) for i, lang, t in zip(pdf["h"], pdf["lang"], pdf["text"], strict=True) if (v := vector(t)) is not None]
            if rows:
                yield pd.DataFrame({"h": [r[0] for r in rows], "lang": [r[1] for r in rows], "v": [r[2].tobytes() for r in rows]})

    got = drawn.mapInPandas(run, "h long, lang string, v binary").toPandas()  # a few MB a language
    if got.empty:
        return Model()
    got = got.drop_duplicates(["lang", "v"]).sort_values(["lang", "h", "v"], ignore_index=True)
    return fit_model(list(got["lang"]), np.stack([np.frombuffer(v, dtype=np.float32) for v in got["v"]]), families or FAMILIES)


def predictor(spark: SparkSession, model: Model):
    """A pandas UDF from text to (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)  # (families + pairs) x DIM numbers

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts)

    return predict


def learnable() -> Column:
    """Holds for documents that a model may learn from."""
    return crc_mod("doc_id", 3) != 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    predict = predictor(spark, train(docs, learn=learnable()))
    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


QUERIES = {"op1_language_id": op1_language_id}
ORACLE = {}
