"""Exact deduplication by Grace hashing: records go to spill files by digits of their hash until each bucket fits an
open-addressing table that compares complete contents.

Each task first puts the texts that it reads through a table of its own, a bounded number of bytes at a time, so a text
that a third of all rows hold leaves a task about once. What is left, the records, is written to spill files in the shared
folder, together with a row for each document that names its record. Records are dealt into buckets by a digit of
their SHA-256; buckets that are too large are dealt again by the next digit. A bucket that digits can't split holds copies of one text
from many tasks: its records are merged in salted parts first, which leaves one a part. Buckets that fit are worked through
with a table each. Documents then take their record's class by a join, so a class's documents never meet in one task.

Results in corner cases: null counts as the empty text; A-Z are lower-cased, nothing else; null ids are smaller than all
others; of rows repeated with id and text exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, drop_stored, pick, stored, table

#: Bytes of contents that a task holds before it gives its records on, that a bucket should have, and may have at most.
HELD, TARGET, LIMIT = 32 << 20, 4 << 20, 16 << 20
#: Bytes that a record counts besides its content.
RECORD = 128
#: Buckets of the first digit at least, and of each further digit.
FIRST, NEXT = 256, 64
#: Bytes of a batch of records that goes back to Spark.
BATCH = 4 << 20
#: Buckets that are too large are looked up in a broadcast set up to this number.
SMALL = 100_000

SPILL = pa.schema([
    ("kind", pa.int32()), ("ref", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()),
    ("n", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("sha", pa.binary()), ("content", pa.binary()),
])
SPILL_DDL = "kind int, ref long, row long, doc_id long, n long, keep_id long, keep_row long, sha binary, content binary"
FINAL_DDL = "ref long, class long, n long, keep_id long, keep_row long, sha binary"


class ContentTable:
    """A hash table with linear probing: contents by number, equal ones under the same number."""

    def __init__(self, slots: int = 256):
        self.slots = [-1] * slots
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []

    def number(self, digest: bytes, content: bytes) -> int:
        """The content's number; new ones get the next."""
        at = self._slot(digest, content)
        if self.slots[at] < 0:
            if 2 * len(self.contents) >= len(self.slots):
                self._grow()
                at = self._slot(digest, content)
            self.slots[at] = len(self.contents)
            self.digests.append(digest)
            self.contents.append(content)
        return self.slots[at]

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0 and not (self.digests[k] == digest and self.contents[k] == content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _stays(a: tuple, b: tuple) -> tuple:
    """Of two (doc_id, row) the one that stays: the larger id, null below all, then the smaller row."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))


class _Records:
    """The records of one table: what each class has so far."""

    def __init__(self):
        self.table, self.refs, self.n, self.keep, self.held = ContentTable(), [], [], [], 0

    def add(self, digest: bytes, content: bytes, ref: int, n: int, keep: tuple) -> int:
        k = self.table.number(digest, content)
        if k == len(self.refs):
            self.refs.append(ref)
            self.n.append(n)
            self.keep.append(keep)
            self.held += len(content) + RECORD
        else:
            self.n[k] += n
            self.keep[k] = _stays(self.keep[k], keep)
        return k

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The records, a bounded number of bytes at a time."""
        lo = size = 0
        for k, content in enumerate(self.table.contents):
            size += len(content)
            if size >= BATCH or k == len(self.refs) - 1:
                part = slice(lo, k + 1)
                yield _batch(k + 1 - lo, kind=[0] * (k + 1 - lo), ref=self.refs[part], n=self.n[part], keep_id=[i for i, _ in self.keep[part]], keep_row=[r for _, r in self.keep[part]], sha=self.table.digests[part], content=self.table.contents[part])
                lo, size = k + 1, 0


def _batch(rows: int, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * rows), type=f.type) for f in SPILL], schema=SPILL)


def spill(docs: DataFrame, held: int = HELD) -> DataFrame:
    """The stored table of records (kind 0) and of the documents that name them (kind 1)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        records = _Records()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            refs = []
            for k, doc_id in enumerate(ids):
                content = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").lower()  # of bytes, A-Z only
                at = records.add(hashlib.sha256(content).digest(), content, row + k, 1, (doc_id, row + k))
                refs.append(records.refs[at])
            yield _batch(len(ids), kind=[1] * len(ids), ref=refs, row=list(range(row, row + len(ids))), doc_id=ids)
            row += len(ids)
            if records.held >= held:
                yield from records.batches()
                records = _Records()
        yield from records.batches()

    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.mapInArrow(run, SPILL_DDL), "spill")


def _added(records: _Records, group: pa.Table) -> list[int]:
    """Puts a group's records into a table; the numbers that they get."""
    columns = (group[c].to_pylist() for c in ("sha", "content", "ref", "n", "keep_id", "keep_row"))
    return [records.add(sha, content, ref, n, (i, r)) for sha, content, ref, n, i, r in zip(*columns, strict=True)]


def _merged(records: DataFrame, *keys: str) -> DataFrame:
    """Records after those of equal content in each group became one (kind 0), and the record that each went into (kind 1)."""

    def run(group: pa.Table) -> pa.Table:
        out, refs = _Records(), group["ref"].to_pylist()
        into = [out.refs[k] for k in _added(out, group)]
        return pa.Table.from_batches([*out.batches(), _batch(len(refs), kind=[1] * len(refs), ref=refs, row=into)], schema=SPILL)

    return records.groupBy(*keys).applyInArrow(run, SPILL_DDL)


def _classes(records: DataFrame) -> DataFrame:
    """What becomes of each record of whole buckets: its class and what this keeps."""

    def run(group: pa.Table) -> pa.Table:
        out = _Records()
        at = _added(out, group)
        of = {"class": [out.refs[k] for k in at], "n": [out.n[k] for k in at], "keep_id": [out.keep[k][0] for k in at], "keep_row": [out.keep[k][1] for k in at]}
        return pa.table({"ref": group["ref"], **{c: pa.array(v, pa.int64()) for c, v in of.items()}, "sha": group["sha"]})

    return records.groupBy("path").applyInArrow(run, FINAL_DDL)


def classes(records: DataFrame, target: int = TARGET, limit: int = LIMIT, first: int = FIRST, deepest: int = 64) -> DataFrame:
    """ref, class, n, keep_id, keep_row, sha for every record of a spill table, as a stored table."""
    size = F.octet_length("content") + RECORD
    now = records.filter("kind = 0").drop("kind", "row", "doc_id")
    total = now.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    path = F.pmod(F.xxhash64(F.lit(0), "sha"), F.lit(max(first, -(-total // target))))
    now = now.withColumn("path", path)
    done, moves, used = [], [], []
    for digit in range(1, deepest + 1):
        sizes = now.groupBy("path").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_count"))
        over = stored(sizes.filter((F.col("_bytes") > limit) & (F.col("_count") > 2)), "over")
        used.append(over)
        n_over = over.count()
        if not n_over:
            done.append(stored(_classes(now), "classes"))
            break
        large = F.broadcast(over) if n_over <= SMALL else over
        done.append(stored(_classes(now.join(large, "path", "left_anti")), "classes"))
        parts = F.least(F.ceil(F.col("_bytes") / limit), F.ceil(F.col("_count") / 2))
        salted = now.join(large, "path").withColumn("_part", F.pmod(F.xxhash64("ref"), parts)).drop("_bytes", "_count")
        merged = stored(_merged(salted, "path", "_part"), "merged")
        used.append(merged)
        moves.append(merged.filter("kind = 1 AND ref != row").select("ref", F.col("row").alias("_into")))
        path = F.xxhash64(path, F.pmod(F.xxhash64(F.lit(digit), "sha"), F.lit(NEXT)))
        now = merged.filter("kind = 0").drop("kind", "row", "doc_id").withColumn("path", path)
    else:
        raise RuntimeError(f"a bucket is too large after {deepest} digits")
    out = reduce(DataFrame.unionByName, done)
    for moved in reversed(moves):  # records that went into others
        into = out.withColumnRenamed("ref", "_into")
        out = out.unionByName(moved.join(into, "_into").select(*out.columns))
    if moves:
        out = stored(out, "classes")
        for x in done:
            drop_stored(x)
    for x in used:
        drop_stored(x)
    return out


def deduplicate(docs: DataFrame, held: int = HELD, target: int = TARGET, limit: int = LIMIT, first: int = FIRST) -> DataFrame:
    """doc_id, class, keep_id, group_size, kept, sha for every row: the number of its class of equal texts, the id of the row that
    stays, the number of rows, whether this one stays, and the digest of the lower-cased text."""
    rows = spill(docs, held)
    of = classes(rows, target, limit, first)
    members = rows.filter("kind = 1").select("ref", "row", "doc_id")
    out = members.join(of, "ref")
    return out.select("doc_id", "class", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "sha")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLE = {
    "op13_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
}
