"""Mixing sources to target weights (operator 1), DataFrame operations only.

Targets: each source gets a share of the budget by weight, no more than ``most`` times its size; what
is over is shared again by weight until no source is above.  That fixed point has a closed form: with
sources sorted by cap per weight, a prefix of them is at its cap and the others share the rest.

Sampling: systematic, by source.  A document's expected number of copies is its source's target over
its source's size.  These numbers are summed along the source, one offset per source (from a hash of its
name and the seed) is added, and a document is emitted once for each integer boundary that its stretch crosses.
Documents run in the order of their size class, so short and long ones are sampled alike and the words
taken stay within about the largest document of the target.

A source may hold most rows: a task sorts one (source, size class, slice) group only, and the starts of
the groups come from sums (see ``common.grouped_rank``).  Slices go by a hash of doc_id and size, and there are more of them the more documents there are.  One row per source meets in one task for the
targets: a table of sources, made by partial aggregation.

Nulls: a null text has size 0, a null source is a source of its own (the last one), a null doc_id comes
first in its group.  Documents of size 0 take part with 0 words.  Repeated rows are rows of their own.
Empty tables give empty results.  Extra columns are ignored by ``mix`` and kept by ``mixed_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolith.llm.common import grouped_rank, materialize, table, word_count

WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
#: Slices of a size class: this many at least, and one for so many documents.
SLICES, PER_SLICE = 32, 65_536


def size_class(size: Column) -> Column:
    """Eighths of powers of two, in whole numbers: 0 for 0."""
    power = F.length(F.bin(size)) - 1
    steps = F.expr("shiftright(shiftleft(size, 3), length(bin(size)) - 1)")
    return F.when(size > 0, power * 8 + steps - 7).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Adds weight and target to rows of (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # binary order of UTF-8 is code-point order
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # level of water if this source and all after it share what is left; the first source below its cap sets it
    rows = rows.withColumn("_full", F.col("_cap") * F.col("_share") <= F.col("_left") * F.col("weight"))
    rows = rows.withColumn("_full", F.min("_full").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_first", F.min(F.when(~F.col("_full"), F.struct((-F.col("_share")).alias("k"), "_left", "_share"))).over(everything))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_first._left") * F.col("weight") / F.col("_first._share"))
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _leading(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) per source."""
    return _leading(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit(""))))) / F.lit(float(1 << 32))


def copies(sized: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source and size; other columns stay."""
    # small rows, read a few times; the texts only once
    rows = materialize(sized, "sizes").withColumn("_class", size_class(F.col("size")))
    slices = max(SLICES, rows.count() // PER_SLICE)
    slice_ = _leading(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))) % slices
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, **how).select(F.col("source").alias("_source"), "source_size", "target")
    ranked = grouped_rank(rows, ["source"], ["doc_id", "size"], F.col("_class") * slices + slice_)
    out = ranked.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("source"), seed)
    crossed = F.floor((F.col("rank") + 1) * each + start) - F.floor(F.col("rank") * each + start)
    return out.withColumn("copies", F.least(crossed, F.ceil(each)).cast("long")).drop("_class", "_source", "rank")


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    out = copies(sized, seed, **how)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_h"))
    # decisions are made on small rows; equal rows (same doc_id and text) share them one by one
    last = F.lit((1 << 63) - 1)
    taken = copies(sized, seed, **how).groupBy(F.coalesce("doc_id", last).alias("_k"), F.col("_h").alias("_t")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), last).alias("_k"), F.xxhash64("text").alias("_t"))
    both = keyed.join(taken, ["_k", "_t"])  # the window below finds its rows where this join left them
    nth = F.row_number().over(Window.partitionBy("_k", "_t").orderBy(F.lit(1)))
    both = both.withColumn("_times", F.floor(F.col("_copies") * nth / F.col("_rows")) - F.floor(F.col("_copies") * (nth - 1) / F.col("_rows")))
    return both.filter("_times > 0").select(F.explode(F.array_repeat("_row", F.col("_times").cast("int"))).alias("_row")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share
      FROM w WINDOW up AS (ORDER BY cap / weight, encode(source) NULLS LAST)),
f AS (SELECT *, bool_and(cap * share <= rest * weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS is_full FROM r),
g AS (SELECT source, source_size, weight, cap, is_full, (SELECT {'rest': rest, 'share': share} FROM f WHERE NOT is_full ORDER BY share DESC LIMIT 1) AS o FROM f),
t AS (SELECT source, source_size, coalesce(CASE WHEN is_full THEN cap ELSE o.rest * weight / o.share END, 0) AS target FROM g),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
             ('0x' || md5('mix:' || coalesce(d.source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS start,
             row_number() OVER (PARTITION BY d.source ORDER BY
                 CASE WHEN size > 0 THEN (length(bin(size)) - 1) * 8 + ((size::BIGINT << 3) >> (length(bin(size)) - 1)) - 7 ELSE 0 END,
                 ('0x' || md5(coalesce(d.doc_id::VARCHAR, '') || ':' || size::VARCHAR)[1:8])::BIGINT % (SELECT greatest(32, count(*) // 65536) FROM d), d.doc_id) - 1 AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor((n + 1) * each + start) - floor(n * each + start), ceil(each))::BIGINT AS copies FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size AS taken, copies FROM c
"""
