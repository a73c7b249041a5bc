"""Document fingerprints from prefix polynomial hashes (operator 4).

``PrefixHash`` keeps modular prefix arrays of a text's code points: any span's hash takes two look-ups,
and a binary search over span equality finds the longest common extension of two positions.

A fingerprint is read off those arrays: the length, the hash of the whole text, the hashes of a
ladder of prefixes (lengths grow by an eighth root of 2, about 9 %), and the smallest ``SKETCH`` hashes of all
spans of ``SPAN`` code points.  The likeness of two fingerprints is 1 if they are equal, otherwise the larger of the
longest ladder prefix they share, as a share of the longer text, found by binary search, and the
Jaccard estimate from the span hashes.  That is read off the fingerprints alone; the true longest common extension from the
start of the text, with its edited text and with the next one, is reported beside it (``common_edited``, ``common_next``).

The next document, in descending order of doc_id, is found without a global sort: doc_ids are cut at approximate
quantiles, whatever their gaps, into ranges ("blocks") of about as many rows, a task streams each block in order, and each block also gets the first
document of the next one.  At most ``BLOCKS`` bounds and first ids are broadcast (8 and 16 octets each).

Nulls: a null text is empty, a null doc_id comes last (all of them are one block).  Empty texts have no prefixes and no spans;
their likeness to any other text is 0.  Repeated rows and ties of doc_id come in the order of their texts.
A lone document is its own next one.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolith.llm.common import table

MODULI, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 998_244_353)
SPAN, SKETCH = 16, 48
DOCS_PER_BLOCK, BLOCKS = 256, 1 << 17
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


#: Prefix lengths: 1, 2, 3, ..., then growing by an eighth root of 2.
RUNGS = sorted({round(2 ** (k / 8)) for k in range(8 * 40)})


def _ladder(n: int) -> list[int]:
    """Prefix lengths up to n."""
    return RUNGS[: bisect_right(RUNGS, n)]


class Powers:
    """Powers of the bases and their inverses, as far as needed; a worker keeps them between tasks."""

    def __init__(self) -> None:
        self.up = [np.ones(1, dtype=np.uint64) for _ in MODULI]
        self.down = [np.ones(1, dtype=np.uint64) for _ in MODULI]

    def reach(self, n: int) -> None:
        while len(self.up[0]) <= n:
            have = len(self.up[0])
            for k, (m, b) in enumerate(zip(MODULI, BASES, strict=True)):
                for arrays, base in ((self.up, b), (self.down, pow(b, -1, m))):
                    arrays[k] = np.concatenate([arrays[k], arrays[k] * np.uint64(pow(base, have, m)) % np.uint64(m)])


class PrefixHash:
    """Prefix hashes of a text; spans are compared by 62 bits."""

    def __init__(self, text: str, powers: Powers) -> None:
        self.n, self.powers = len(text), powers
        powers.reach(self.n + 1)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, m in enumerate(MODULI):
            terms = points * powers.up[k][: self.n] % np.uint64(m)
            self.sums.append(np.r_[np.zeros(1, dtype=np.uint64), np.cumsum(terms) % np.uint64(m)])

    def part(self, k: int, begin: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """Hash by modulus k of the spans [begin, end), whatever their place."""
        m = np.uint64(MODULI[k])
        return (self.sums[k][end] + m - self.sums[k][begin]) % m * self.powers.down[k][begin] % m

    def span(self, begin: int, end: int) -> int:
        return int(self.part(0, begin, end)) << 31 | int(self.part(1, begin, end))

    def equal(self, i: int, other: PrefixHash, j: int, n: int) -> bool:
        return i + n <= self.n and j + n <= other.n and self.span(i, i + n) == other.span(j, j + n)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the right of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def fingerprint(text: str, powers: Powers) -> str:
    return fingerprint_of(PrefixHash(text, powers))


def fingerprint_of(p: PrefixHash) -> str:
    """``length.whole.ladder.sketch`` in hex digits."""
    steps = _ladder(p.n)
    ladder = "".join(f"{int(x) & 0xFFFFFF:06x}" for x in p.sums[0][steps]) if steps else ""
    sketch = ""
    if p.n:
        begin = np.arange(max(1, p.n - SPAN + 1))
        h = p.part(0, begin, np.minimum(begin + SPAN, p.n)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
        take = 2 * SKETCH
        while True:
            least = np.unique(np.partition(h, take - 1)[:take] if take < len(h) else h)
            if len(least) >= SKETCH or take >= len(h):
                break
            take *= 4
        sketch = "".join(f"{x:08x}" for x in least[:SKETCH].tolist())
    return f"{p.n:x}.{p.span(0, p.n):016x}.{ladder}.{sketch}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (na, _, la, sa), (nb, _, lb, sb) = a.split("."), b.split(".")
    na, nb = int(na, 16), int(nb, 16)
    if not na or not nb:
        return 0.0
    low, high = 0, min(len(la), len(lb)) // 6  # equal prefixes stay equal when cut: binary search
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if la[6 * mid - 6 : 6 * mid] == lb[6 * mid - 6 : 6 * mid] else (low, mid - 1)
    prefix = (_ladder(min(na, nb))[low - 1] if low else 0) / max(na, nb)
    xa, xb = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (sa, sb))
    least = sorted(xa | xb)[:SKETCH]
    return max(prefix, sum(x in xa and x in xb for x in least) / len(least))


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many from the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document; see SCHEMA."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.agg(F.count("doc_id")).first()[0]
    blocks = max(1, min(BLOCKS, n // DOCS_PER_BLOCK))
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit(np.arange(1, blocks) / blocks), 8 * blocks)).first()[0] if blocks > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))
    held = spark.sparkContext.broadcast(cuts)

    def place(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False)), pa.int64())

    block = F.when(F.col("doc_id").isNull(), -1).otherwise(F.arrow_udf(place, "long")("doc_id"))
    own = docs.withColumn("block", block)
    tops = own.groupBy("block").agg(F.max("doc_id").alias("top"))  # at most BLOCKS + 2 rows
    down = Window.orderBy("block")
    before = F.coalesce(F.lead("block").over(down), F.first("block").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("block").alias("_b"), F.col("top").alias("_top"), before.alias("before"))
    heads = own.join(F.broadcast(tops), (F.col("block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = heads.groupBy(F.col("before").alias("block")).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = own.select("block", F.lit(0).alias("head"), "doc_id", "text").unionByName(heads.select("block", F.lit(1).alias("head"), "doc_id", "text"))
    store = spark.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = store.value.setdefault("powers", Powers())
        waiting = None
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for where, head, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py()
                hashed = PrefixHash(text, powers)
                own = fingerprint_of(hashed)
                if waiting and waiting[0] == where:
                    _, d, t, f, p = waiting
                    changed = edited(t, text)
                    q = p if changed == t else PrefixHash(changed, powers)
                    new = f if changed == t else fingerprint_of(q)
                    common = (p.common_extension(0, q, 0), p.common_extension(0, hashed, 0))
                    row = (d, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, new, likeness(f, new), likeness(f, own), *common)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                waiting = None if head else (where, doc_id, text, own, hashed)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    ordered = rows.repartition("block").sortWithinPartitions("block", "head", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(run, SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
