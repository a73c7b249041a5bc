"""Exact deduplication behind static binary-fuse filters (operator 10).

A snapshot is immutable: its digests are summed up once and its 64-bit keys go into binary-fuse
filters, one per shard of the key space, kept in the shared folder.  An incoming batch is summed up by
digest on its own (its inner duplicates meet there, by partial aggregation), then each of its
digests is probed in its shard's filter.  A negative is proven new.  Positives join the snapshot's
exact buckets by SHA-256, which removes the filter's false positives.  What is left as a group of
several rows is checked byte by byte: the rows' normalised texts are grouped themselves (partial
aggregation sends one copy per task and text, so a hot group stays small), screened by a filter of the
groups' keys where that filter is small enough to broadcast, by a semi-join beyond.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the
row with the largest doc_id stays; a null doc_id is below any other, and repeated rows with the
largest doc_id all stay.  Extra columns are ignored; an empty table gives an empty result.  Very
long texts are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import ascii_lower, materialize, table

#: Shards of the key space: this many at least, and one for so many keys.
SHARDS, PER_SHARD = 256, 1_000_000
#: Filters are broadcast up to this many keys (about 1.2 octets each); beyond, a join does their work.
BROADCAST_KEYS = 16_000_000


class BinaryFuse8:
    """Static filter of distinct 64-bit keys: three cells in neighbouring segments, 8-bit fingerprints."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        x = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))

    @staticmethod
    def _cells(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        span, mask = segment * segments, np.uint64(segment - 1)
        high, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
        first = ((high * np.uint64(span) + ((low * np.uint64(span)) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)
        return first, (first + segment) ^ ((h >> np.uint64(18)) & mask).astype(np.int64), (first + 2 * segment) ^ (h & mask).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        cells = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) if n > 1 else 4
        segments = max(1, -(-cells // segment) - 2)
        for seed in range(1, 200):
            h = cls._mix(keys, seed * 0x9E3779B97F4A7C15)
            at = np.stack(cls._cells(h, segment, segments))
            size = (segments + 2) * segment
            count = np.bincount(at.ravel(), minlength=size)
            owner = np.zeros(size, dtype=np.int64)
            for row in at:
                np.add.at(owner, row, np.arange(n))
            rounds, ready = [], np.flatnonzero(count == 1)
            peeled = 0
            while ready.size:
                key, where = np.unique(owner[ready], return_index=True)
                rounds.append((key, ready[where]))
                peeled += len(key)
                touched = at[:, key]
                for row in touched:
                    np.subtract.at(count, row, 1)
                    np.subtract.at(owner, row, key)
                touched = np.unique(touched)
                ready = touched[count[touched] == 1]
            if peeled == n:
                table_, prints = np.zeros(size, dtype=np.uint8), cls._print(h)
                for key, cell in reversed(rounds):  # a peeled cell is no other key's cell in its round, and 0 so far
                    table_[cell] = prints[key] ^ table_[at[0, key]] ^ table_[at[1, key]] ^ table_[at[2, key]]
                return cls(seed * 0x9E3779B97F4A7C15, segment, segments, table_)
            segments += 1 + segments // 50  # a little more room each time
        raise RuntimeError("the filter could not be built")

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        h = self._mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._cells(h, self.segment, self.segments)
        return self._print(h) == self.cells[a] ^ self.cells[b] ^ self.cells[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed & 0xFFFFFFFFFFFFFFFF, self.segment, self.segments], dtype="<u8").tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse8:
        seed, segment, segments = (int(x) for x in np.frombuffer(data[:24], dtype="<u8"))
        return cls(seed, segment, segments, np.frombuffer(data, dtype=np.uint8, offset=24))


def shards_for(n: int) -> int:
    return max(SHARDS, n // PER_SHARD)


def _shard(shards: int, key: str = "key") -> Column:
    return F.pmod(F.col(key), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, filter): one filter per shard of the distinct values of ``keys.key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            data = BinaryFuse8.build(np.concatenate(parts).view(np.uint64)).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "filter"])

        now, parts = None, []
        for b in batches:
            shard, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), [*cuts[1:], len(shard)], strict=True):
                if now is not None and shard[lo] != now:
                    yield made(now, parts)
                    parts = []
                now = int(shard[lo])
                parts.append(key[lo:hi])
        if parts:
            yield made(now, parts)

    rows = keys.select(_shard(shards).alias("shard"), "key").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard int, filter binary")


def screen(filters: DataFrame, batch: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of ``batch`` (key, sha) that the filter of their shard might hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:  # in each shard the filter comes first, if there is one
            shard, key = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            hit = np.zeros(len(shard), dtype=bool)
            for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), [*cuts[1:], len(shard)], strict=True):
                if shard[lo] != now:
                    now, held = shard[lo], None
                if data := b.column(3)[int(lo)].as_py():
                    held = BinaryFuse8.from_bytes(data)
                    lo += 1
                if held is not None and hi > lo:
                    hit[lo:hi] = held.might_hold(key[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(4).filter(pa.array(hit))], names=["sha"])

    none = F.lit(None)
    rows = filters.select("shard", F.lit(0).alias("side"), F.lit(0).cast("long").alias("key"), "filter", none.cast("binary").alias("sha")).unionByName(
        batch.select(_shard(shards).alias("shard"), F.lit(1).alias("side"), "key", none.cast("binary").alias("filter"), "sha")
    )
    return rows.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(run, "sha binary")


def normalised() -> Column:
    return ascii_lower(F.coalesce("text", F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sha, new): one row per document, without the text."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("_t"), F.col("_new").alias("new"))
    return norm.select("doc_id", F.xxhash64("_t").alias("key"), F.unhex(F.sha2("_t", 256)).alias("sha"), "new")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))


def deduplicate(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per row of either: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = snapshot.sparkSession
    docs = snapshot.select("doc_id", "text", F.lit(False).alias("_new")).unionByName(batch.select("doc_id", "text", F.lit(True).alias("_new")))
    rows = materialize(digests(docs), "digests")
    old, new = _summed(rows.filter(~F.col("new"))), _summed(rows.filter("new"))
    shards = shards_for(rows.count())
    filters = materialize(build_filters(old, shards), "filters")
    positive = screen(filters, new, shards).select(F.col("sha").alias("_p"))
    buckets = old.select(F.col("sha").alias("_o"), F.col("n").alias("_on"))
    hits = positive.join(buckets, F.col("_p") == F.col("_o")).select(F.col("_o").alias("_s"), "_on")
    both = new.join(hits, new.sha == hits._s, "left").select("sha", "key", (F.col("n") + F.coalesce("_on", F.lit(0))).alias("n"))
    # of the snapshot, only its inner duplicates are missing there
    several = materialize(both.filter("n > 1").select("sha", "key").union(old.filter("n > 1").select("sha", "key")).distinct(), "several")
    verified = check_bytes(spark, docs, several)
    out = rows.join(verified, rows.sha == verified._sha, "left")
    keep = F.when(F.col("_sha").isNull(), F.col("doc_id")).otherwise(F.col("_top"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def check_bytes(spark: SparkSession, docs: DataFrame, several: DataFrame) -> DataFrame:
    """(_sha, _n, _top) of the digests in ``several``, from grouping the texts themselves.

    Two texts with one SHA-256 stop the job: a defined result in place of a wrong one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("_t")).withColumn("_key", F.xxhash64("_t"))
    if several.count() <= BROADCAST_KEYS:
        parts = {r.shard: r.filter for r in build_filters(several).collect()}  # at most 1.3 octets for each of BROADCAST_KEYS
        held = spark.sparkContext.broadcast(parts)

        def run(keys: pa.Array) -> pa.Array:
            key = keys.to_numpy(zero_copy_only=False).astype(np.int64)
            shard, hit = np.mod(key, SHARDS), np.zeros(len(key), dtype=bool)
            for s in np.unique(shard):
                if data := held.value.get(int(s)):
                    hit[shard == s] = BinaryFuse8.from_bytes(data).might_hold(key[shard == s].view(np.uint64))
            return pa.array(hit)

        texts = texts.filter(F.arrow_udf(run, "boolean")("_key"))
    else:
        texts = texts.join(several.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi")
    exact = texts.groupBy("_key", "_t").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    exact = exact.select(F.unhex(F.sha2("_t", 256)).alias("_sha"), "n", "top")
    out = exact.groupBy("_sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("_n"), F.max("top").alias("_top"))
    n = F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts with one SHA-256"))).otherwise(F.col("_n"))
    return out.select("_sha", n.cast("long").alias("_n"), "_top").filter("_n > 1")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows (by a hash of the doc_id) are the snapshot, the others the incoming batch."""
    docs = table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return deduplicate(docs.filter(half), docs.filter(~half))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
