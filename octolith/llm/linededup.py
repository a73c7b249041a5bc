"""Line dedup with a log-template tree (operator 3), DataFrame operations only.

The tree has a fixed depth: a line goes down by its number of tokens and by its first ``LEAD`` tokens, where
a token with a digit counts as a variable field, ``<*>``.  In a leaf, lines with equal masked tokens
share a template.  A leaf with several templates gets generalised ones too, as many as recur, in rounds over groups of its lines (first the
whole leaf): each place takes its commonest token, and lines that agree with it in at least ``SIMILAR`` of the places
belong to it if they recur; the places that differ are its variable fields.  The other lines are dealt into smaller groups by their token at
one place, the one with the fewest lines whose token there is rare in the group; lines with a rare token stay together.  Every round makes one more
place of a group constant or all rare, so the rounds end by themselves: when no group is left that could recur.

A template that recurs in at least ``MIN_DOCS`` documents is dropped everywhere but in the first of
them (smallest doc_id, then text hash), so of a group of copies one document keeps its lines.
Lines equal word for word, numbers too, are dropped so from ``EXACT_DOCS`` documents on; lines of fewer than ``MIN_TOKENS`` tokens only
by such equality, from ``SHORT_DOCS`` documents on.  Blank lines always stay.

Lines travel as hashes, never as text; documents are shuffled once, to rebuild the texts.  Counts are
partial aggregations; a template in every document is one row after them.

Nulls: a null text has no lines and stays null; a null doc_id comes last in the order.  Repeated rows (same doc_id and text)
count as one document and get the same result.  Empty tables give empty results.  Extra columns are ignored by
``line_report`` and kept by ``without_templates``.  Very long texts and lines are read whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import discard, materialize, table

LEAD, SIMILAR, MIN_DOCS, MIN_TOKENS = 3, 0.8, 3, 3
EXACT_DOCS, SHORT_DOCS = 2, 10
_SPACE, _ODD_SPACE = r"\x20\x09-\x0D", "\t\x0b\x0c\r"
#: A whole token with a digit, in a line whose white space is spaces; possessive, so that it takes linear time.
_VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
_KEYS = ("_k1", "_k2")


def _keyed(docs: DataFrame) -> DataFrame:
    """A document's key: doc_id (null: the largest number) and a hash of its text."""
    return docs.withColumn("_k1", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("_k2", F.xxhash64("text"))


def parse_lines(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, pos, leaf, h, exact, parts): the way of each line down the tree, a hash of its words (null if as h: no digit) and 16 bits of each token's hash."""

    def words(x: Column) -> Column:
        return F.array_remove(F.split(x, " "), "")  # by one character: no pattern is run

    # each step reads its columns several times, so they stay apart; a filter on tokens would be pushed below them and split every line twice
    odd = reduce(or_, [F.contains("text", F.lit(c)) for c in _ODD_SPACE])  # cheaper than translating every text
    text = F.when(odd, F.translate("text", _ODD_SPACE, " " * len(_ODD_SPACE))).otherwise(F.col("text"))
    rows = docs.select(*_KEYS, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    rows = rows.select(*_KEYS, "pos", "line", F.col("line").rlike("[0-9]").alias("d"))
    rows = rows.select(*_KEYS, "pos", words(F.when(F.col("d"), F.regexp_replace("line", _VARIABLE, "<*>")).otherwise(F.col("line"))).alias("t"), F.when(F.col("d"), F.xxhash64(F.array_join(words(F.col("line")), " "))).alias("exact"))
    n = F.size("t")
    parts = F.when(n >= MIN_TOKENS, F.transform("t", lambda x: F.shiftright(F.hash(x), 16).cast("short")))
    return rows.select(*_KEYS, "pos", F.xxhash64(n, F.slice("t", 1, LEAD)).alias("leaf"), F.xxhash64(F.array_join("t", " ")).alias("h"), "exact", parts.alias("parts"))


def crowded_lines(lines: DataFrame) -> DataFrame:
    """The lines of leaves with lines of two documents at least: nothing else can recur.

    One small row per leaf and task is shuffled to find them (sums, smallest and largest document); the lines themselves travel once, and a leaf
    with most lines is split, as both sides of the join are plain shuffles.
    """
    who = F.xxhash64(*_KEYS)
    leaves = lines.groupBy("leaf").agg(F.min(who).alias("a"), F.max(who).alias("z")).filter("a <> z").select(F.col("leaf").alias("_l"))
    leaves = materialize(leaves, "leaves")
    out = materialize(lines.join(leaves, F.col("leaf") == F.col("_l"), "left_semi"), "crowded")
    discard(leaves)
    return out


def generalised(inside: DataFrame, min_docs: int) -> DataFrame | None:
    """(leaf, h, gid) of the lines (leaf, h, c, parts) that belong to a generalised template; None if there are no lines."""
    pool, found = inside.withColumn("g", F.col("leaf")), None
    while True:
        votes = pool.select("g", "c", F.posexplode("parts").alias("i", "v")).groupBy("g", "i", "v").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k"))
        often = F.col("c") >= min_docs
        places = votes.groupBy("g", "i").agg(
            F.max(F.struct("c", "v")).alias("top"), F.sum("c").alias("c"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("kinds"),
            F.sum(F.when(often, 0).otherwise(F.col("c"))).alias("rare"), F.max(often).alias("often"),
        )
        open_ = F.when((F.col("kinds") > 1) & F.col("often"), F.struct("rare", "kinds", "i"))
        plan = places.groupBy(F.col("g").alias("_g")).agg(
            F.max("c").alias("_c"), F.max("k").alias("_k"), F.array_sort(F.collect_list(F.struct("i", F.col("top.v").alias("v")))).alias("_t"), F.min(open_).getField("i").alias("_i")
        ).filter((F.col("_c") >= min_docs) & (F.col("_k") > 1))
        plan = materialize(plan, "plan")
        agree = F.expr("size(filter(zip_with(parts, _t, (x, y) -> x = y.v), x -> x))")
        step = pool.join(plan, F.col("g") == F.col("_g")).select("leaf", "h", "c", "parts", "g", (agree >= F.size("parts") * SIMILAR).alias("hit"), "_i", F.expr("get(parts, _i)").alias("_v"))
        step = materialize(step, "step")
        if step.isEmpty():
            discard(plan, step)
            return found
        groups = step.filter("hit").groupBy(F.col("g").alias("_g")).agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_k")).filter((F.col("_c") >= min_docs) & (F.col("_k") > 1)).select("_g")
        groups = materialize(groups, "groups")
        told = step.join(groups, F.col("g") == F.col("_g"), "left").withColumn("hit", F.col("hit") & F.col("_g").isNotNull()).drop("_g")
        new = materialize(told.filter("hit").select("leaf", "h", F.xxhash64("g", F.lit("general")).alias("gid")), "general")
        found = new if found is None else found.union(new)
        # the others are dealt by their token at the group's place; rare tokens stay together.  Frequent tokens are rows, not a list in one
        rest = told.filter("NOT hit AND _i IS NOT NULL")
        frequent = rest.groupBy(F.col("g").alias("_g"), F.col("_v").alias("_f")).agg(F.lit(1).alias("_one"))
        known = votes.filter(often).join(plan.select(F.col("_g").alias("_p"), F.col("_i").alias("_q")), (F.col("g") == F.col("_p")) & (F.col("i") == F.col("_q")))
        frequent = materialize(frequent.join(known.select("g", "v"), (F.col("_g") == F.col("g")) & (F.col("_f") == F.col("v")), "left_semi"), "frequent")
        dealt = rest.join(frequent, (F.col("g") == F.col("_g")) & (F.col("_v") == F.col("_f")), "left")
        token = F.when(F.col("_one").isNotNull(), F.col("_v").cast("int")).otherwise(1 << 20)
        last, pool = pool, materialize(dealt.select("leaf", "h", "c", "parts", F.xxhash64("g", "_i", token).alias("g")), "pool")
        discard(plan, step, groups, frequent, *([last] if last is not None and hasattr(last, "_stored_at") else []))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, h, gid, long): lines that may recur; gid is null if only lines equal word for word can; documents are counted later."""
    who = F.xxhash64(*_KEYS)
    templates = lines.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("c"), F.min(who).alias("a"), F.max(who).alias("z"), F.first("parts").alias("parts"), F.count("exact").alias("exact"))
    templates = materialize(templates, "templates")
    long = F.col("parts").isNotNull()
    leaves = materialize(templates.filter(long).groupBy("leaf").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c")).filter((F.col("k") > 1) & (F.col("c") >= min_docs)).select(F.col("leaf").alias("_l")), "leaves")
    inside = materialize(templates.filter(long).join(leaves, F.col("leaf") == F.col("_l"), "left_semi").select("leaf", "h", "c", "parts"), "several")
    general = generalised(inside, min_docs)
    # a line is asked for the generalised template first; without digits, an equal template is an equal line
    same = F.when(long & (F.col("exact") > 0) & (F.col("c") >= min_docs), F.xxhash64("leaf", "h"))
    rows = templates.select("leaf", "h", same.alias("gid"), long.alias("long"), (F.col("a") != F.col("z")).alias("two"))
    if general is not None:
        named = general.select(F.col("leaf").alias("_l"), F.col("h").alias("_h"), F.col("gid").alias("_g"))
        rows = rows.join(named, (F.col("leaf") == F.col("_l")) & (F.col("h") == F.col("_h")), "left").select("leaf", "h", F.coalesce("_g", "gid").alias("gid"), "long", (F.col("two") | F.col("_g").isNotNull()).alias("two"))
    found = materialize(rows.filter("two").drop("two"), "recurring")
    discard(templates, leaves, inside)
    return found


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_k1, _k2, drops): line numbers (from 0) that go, for each document that loses any."""
    every = materialize(parse_lines(_keyed(docs)), "lines")
    lines = crowded_lines(every)
    discard(every)
    found = recurring(lines, min_docs).select(F.col("leaf").alias("_l"), F.col("h").alias("_h"), "gid", "long")
    hits = lines.join(found, (F.col("leaf") == F.col("_l")) & (F.col("h") == F.col("_h")))
    equal = F.struct(F.xxhash64("leaf", F.coalesce("exact", "h"), F.lit("equal")).alias("gid"), F.when(F.col("long"), EXACT_DOCS).otherwise(SHORT_DOCS).alias("least"))
    groups = F.array_compact(F.array(F.when(F.col("gid").isNotNull(), F.struct("gid", F.lit(min_docs).alias("least"))), equal))
    hits = materialize(hits.select(*_KEYS, "pos", F.explode(groups).alias("x")).select(*_KEYS, "pos", "x.*"), "hits")
    discard(lines)
    by_doc = hits.select("gid", "least", *_KEYS).distinct()
    kept = by_doc.groupBy("gid").agg(F.count(F.lit(1)).alias("docs"), F.first("least").alias("least"), F.min(F.struct(*_KEYS)).alias("first")).filter("docs >= least").select(F.col("gid").alias("_g"), "first")
    drop = hits.join(materialize(kept, "kept"), F.col("gid") == F.col("_g")).filter(F.struct(*_KEYS) != F.col("first"))
    return materialize(drop.groupBy(*_KEYS).agg(F.array_sort(F.collect_set("pos")).alias("drops")), "drops")


def _rebuilt(docs: DataFrame, min_docs: int) -> DataFrame:
    """``docs`` (its columns in _row) with drops, number of lines and the text that stays."""
    names = docs.columns
    drops = dropped_lines(docs, min_docs).select(F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2"), "drops")
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text")).drop("doc_id")
    out = rows.join(drops, (F.col("_k1") == F.col("_d1")) & (F.col("_k2") == F.col("_d2")), "left").withColumn("_lines", F.split("text", "\n"))
    stay = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), drops), i -> get(_lines, i)), '\n')")
    return out.withColumn("_text", F.when(F.col("drops").isNull(), F.col("text")).otherwise(stay))


def without_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with shorter texts; documents of which only blank lines are left go."""
    out = _rebuilt(docs, min_docs).filter(F.col("drops").isNull() | F.col("_text").rlike(f"[^{_SPACE}]"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined), text_sha256 of what stays."""
    out = _rebuilt(docs.select("doc_id", "text"), min_docs)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return out.select(
        F.col("_row.doc_id").alias("doc_id"),
        n.alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("drops", ","), F.lit("")).alias("dropped"),
        F.sha2(F.coalesce("_text", F.lit("")), 256).alias("text_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
