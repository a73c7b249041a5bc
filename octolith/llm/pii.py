"""Personal data by weak supervision (operator 5), DataFrame operations only.

Base spans come from four fixed patterns (leftmost, non-overlapping per kind; failing matches are
dropped).  They always stay.  The method looks for more: identifiers and credentials that no fixed
pattern names.  Candidates are runs of letters, digits and joining marks, of any length, with a digit anywhere.  Labelers vote
1 (personal), -1 (not) or 0 (no opinion) on each:

* regex: shapes of bank, tax, social-security and telephone numbers and of keys; plain numbers and versions vote against;
* gazetteer: the word before is in a list of names of such data, or the word after in a list of units;
* context: the marks around (``=``, ``:``, quotes) and words of counting and citing;
* texture: how many different digits and letters the candidate has for its length.

Votes are counted by pattern (at most 3^4 rows, whatever the input).  Expectation-maximisation on these
counts (Dawid and Skene's model; until nothing changes by ``SETTLED``, ``EM_ROUNDS`` at most) estimates each labeler's reliability; the patterns' posteriors are soft labels, with which a
naive Bayes classifier over the span's own features (at most ``FEATURE_ROWS`` values, counted over all candidates)
is trained.  Candidates with a posterior of ``SURE`` or more by the classifier, that don't overlap a base span, become spans of kind ``private``.

Nulls: a null text is empty.  Repeated rows get equal results.  No candidates at all: base spans only.
Empty tables give empty results; extra columns are ignored.  Texts of any length are read whole; patterns
are possessive where a long run could make them slow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone", "private")
_LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns; a match can only begin where a run does or the last match ended, which saves trying each character.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
CANDIDATE_NEEDS = "[0-9]"
LEAST = 7
AROUND, BLOCK = 24, 256

NAMES_BEFORE = ("password", "passwd", "pwd", "token", "key", "apikey", "secret", "ssn", "iban", "passport", "account", "konto", "cuenta", "compte", "phone", "tel", "mobile", "fax", "id", "licence", "license", "login", "user", "pin", "dni", "nif")
UNITS_AFTER = ("km", "kg", "m", "cm", "mm", "g", "usd", "eur", "euro", "euros", "dollars", "percent", "pages", "years", "jahre", "ans", "bytes", "mb", "gb")
COUNTED_BEFORE = ("page", "chapter", "version", "figure", "fig", "table", "year", "isbn", "doi", "issue", "vol", "section", "item")
#: Whole joined tokens (without a name and colon in front), of which some run holds a digit: words are not looked at further.
#: A match begins where a joined token does, so each is scanned once.
_NAME, _BEGIN = f"(?i:{'|'.join(NAMES_BEFORE)})", r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._:/-])"
CANDIDATE = rf"(?:(?<={_BEGIN}{_NAME}:)|{_BEGIN}(?!{_NAME}:[A-Za-z0-9]))(?=[A-Za-z]*+(?:[._:/-][A-Za-z]++)*+[._:/-]?[0-9])[A-Za-z0-9]++(?:[._:/-][A-Za-z0-9]++)*+"

EM_ROUNDS, SETTLED, SURE, FEATURE_ROWS = 1000, 1e-9, 0.9, 400
LABELERS = ("v_regex", "v_gazetteer", "v_context", "v_texture")
FEATURES = ("f_shape", "f_length", "f_left", "f_right", "f_word")
_SPAN = "ARRAY<STRUCT<s: INT, e: INT, m: STRING, b: STRING, a: STRING>>"


def _located(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds column ``name``: all matches with their place and the text around.

    A match begins after the lengths before it.  They are summed by blocks, so that a text of very many matches doesn't cost their square.
    """
    p, none = F.lit(pattern), F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(when, F.regexp_extract_all("t", p, F.lit(0))).otherwise(none))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("t", pattern)).otherwise(none))
    df = df.withColumn("_l", F.expr("transform(_m, (x, k) -> length(x) + length(_g[k]))"))
    df = df.withColumn("_s", F.expr(f"CASE WHEN size(_m) > {BLOCK} THEN transform(sequence(0, (size(_m) - 1) DIV {BLOCK}), b -> aggregate(slice(_l, b * {BLOCK} + 1, {BLOCK}), 0, (x, y) -> x + y)) END"))
    ahead = f"CASE WHEN k < {BLOCK} THEN 0 ELSE aggregate(slice(_s, 1, k DIV {BLOCK}), 0, (x, y) -> x + y) END + aggregate(slice(_l, k DIV {BLOCK} * {BLOCK} + 1, k % {BLOCK}), 0, (x, y) -> x + y) + length(_g[k])"
    df = df.withColumn("_p", F.expr(f"transform(_m, (m, k) -> {ahead})"))
    spans = F.expr(f"transform(_m, (m, k) -> named_struct('s', _p[k], 'e', _p[k] + length(m), 'm', m, 'b', right(_g[k], {AROUND}), 'a', left(_g[k + 1], {AROUND})))")
    return df.withColumn(name, spans.cast(_SPAN)).drop("_m", "_g", "_l", "_s", "_p")


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits is a multiple of 10."""
    one = f"CAST(substr(reverse({digits}), i, 1) AS INT)"
    return f"aggregate(sequence(1, greatest(1, length({digits}))), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {one} WHEN {one} > 4 THEN {one} * 2 - 9 ELSE {one} * 2 END) % 10 = 0"


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, candidates): arrays of spans of each document."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    for kind, pattern in PATTERNS.items():
        needs = F.contains("t", F.lit("@")) if kind == "email" else F.col("t").rlike(NEEDS[kind])
        df = _located(df, kind, pattern, needs)
    df = _located(df, "candidates", CANDIDATE, F.col("t").rlike(CANDIDATE_NEEDS)).drop("t")
    part = "ltrim('0', p)"
    df = df.withColumn("ip", F.expr(f"filter(ip, x -> forall(split(x.m, '[.]'), p -> length({part}) <= 3 AND CAST(concat('0', left({part}, 3)) AS INT) <= 255))"))
    digits = "translate(x.m, ' -', '')"
    df = df.withColumn("card", F.expr(f"filter(card, x -> length({digits}) BETWEEN 14 AND 19)"))
    df = df.withColumn("card", F.expr(f"filter(card, x -> {_luhn(digits)})"))
    df = df.withColumn("phone", F.expr("filter(phone, x -> length(translate(x.m, '+ ().-', '')) BETWEEN 10 AND 15)"))
    fits = f"length(x.m) >= {LEAST}"
    free = " AND ".join(f"NOT exists({k}, y -> y.s < x.e AND x.s < y.e)" for k in PATTERNS)
    df = df.withColumn("candidates", F.expr(f"filter(candidates, x -> {fits})"))
    return df.withColumn("candidates", F.expr(f"filter(candidates, x -> {free})"))


def _words(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _traits(x: str) -> dict[str, str]:
    """SQL of the labelers' votes and the features of a candidate ``x``."""
    before = f"lower(regexp_extract({x}.b, '([A-Za-z]+)[^A-Za-z]*$', 1))"
    after = f"lower(regexp_extract({x}.a, '^[^A-Za-z]*([A-Za-z]+)', 1))"
    left, right_ = f"right(rtrim({x}.b), 1)", f"left({x}.a, 1)"
    kinds = f"size(array_distinct(split({x}.m, '')))"
    good = "^([0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{20,})$"
    poor = "^([0-9]{1,4}([.,:/-][0-9]{1,4})+|[0-9]{1,9}|[a-z]+-?[0-9]{1,4}|.*(com|org|net|html).*)$"
    shape = f"CASE WHEN {x}.m RLIKE '^[0-9]+$' THEN 'digits' WHEN {x}.m RLIKE '^[0-9a-f]+$' THEN 'hex' WHEN {x}.m RLIKE '^[A-Za-z0-9]+$' THEN 'alnum' WHEN {x}.m RLIKE '^[0-9._:/-]+$' THEN 'parts' ELSE 'mixed' END"
    return {
        "v_regex": f"CASE WHEN {x}.m RLIKE '{good}' THEN 1 WHEN {x}.m RLIKE '{poor}' THEN -1 ELSE 0 END",
        "v_gazetteer": f"CASE WHEN {before} IN {_words(NAMES_BEFORE)} THEN 1 WHEN {after} IN {_words(UNITS_AFTER)} THEN -1 ELSE 0 END",
        "v_context": f"CASE WHEN {before} IN {_words(COUNTED_BEFORE)} THEN -1 WHEN {left} IN ('=', ':', '\"') THEN 1 WHEN {left} IN ('(', '[', '/') THEN -1 ELSE 0 END",
        "v_texture": f"CASE WHEN length({x}.m) >= 12 AND {kinds} >= 8 THEN 1 WHEN {kinds} <= 3 THEN -1 ELSE 0 END",
        "f_shape": f"concat('shape:', {shape})",
        "f_length": f"concat('length:', CAST(length(bin(length({x}.m))) AS STRING), ':', CAST(length({x}.m) DIV 8 AS STRING))",
        "f_left": f"concat('left:', {left})",
        "f_right": f"concat('right:', {right_})",
        "f_word": f"concat('word:', CAST(pmod(xxhash64({before}), 64) AS STRING))",
    }


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of "personal" for each pattern of votes, from how often each occurs; starts at the majority vote."""
    post = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v in patterns}
    for _ in range(rounds):
        total = {1: 1.0, 0: 1.0}
        seen: dict[tuple[int, int, int], float] = {}
        for v, n in sorted(patterns.items()):
            for y, p in ((1, post[v]), (0, 1 - post[v])):
                total[y] += n * p
                for j, vote in enumerate(v):
                    seen[j, vote, y] = seen.get((j, vote, y), 0.0) + n * p
        last = dict(post)
        for v in post:
            odds = math.log(total[1] / total[0])
            for j, vote in enumerate(v):
                # one pseudo-count per vote, with a lean towards labelers that do better than chance
                a = (seen.get((j, vote, 1), 0.0) + 1 + 0.5 * vote) / (total[1] + 3)
                b = (seen.get((j, vote, 0), 0.0) + 1 - 0.5 * vote) / (total[0] + 3)
                odds += math.log(a / b)
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if all(abs(post[v] - last[v]) < SETTLED for v in post):
            break
    return post


def train(spans: DataFrame) -> dict[str, float]:
    """Log-odds by feature value (key '' : the prior), from candidates of all documents."""
    traits = {k: F.expr(v) for k, v in _traits("x").items()}
    rows = spans.select(F.explode("candidates").alias("x")).select(*[c.alias(k) for k, c in traits.items()])
    counts = {tuple(int(r[k]) for k in LABELERS): int(r["n"]) for r in rows.groupBy(*LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3^4 rows
    if not counts:
        return {"": -30.0}
    post = expectation_maximisation(counts)
    # whole numbers: the sums don't depend on the order of the rows
    soft = F.element_at(F.create_map(*[F.lit(x) for v, p in sorted(post.items()) for x in (",".join(map(str, v)), round(p * 1_000_000))]), F.concat_ws(",", *LABELERS))
    sums = rows.withColumn("p", soft.cast("long")).select(F.explode(F.array(F.lit(""), *FEATURES)).alias("f"), "p")
    sums = sums.groupBy("f").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    top = {r.f: (r.p / 1e6, r.n) for r in sums.orderBy(F.desc("n"), "f").limit(FEATURE_ROWS).collect()}  # bounded vocabulary: the commonest values
    yes, no = top[""][0], top[""][1] - top[""][0]
    out = {"": math.log((yes + 1) / (no + 1))}
    for f, (p, n) in top.items():
        if f:
            out[f] = math.log((p + 0.5) / (yes + 1)) - math.log((n - p + 0.5) / (no + 1))
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind (the base ones, and ``n_private`` that the method adds), digest of the base spans, all spans."""
    spans = materialize(base_spans(docs), "spans")
    weights = train(spans)
    table_ = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, v)])
    spans = spans.withColumn("_w", table_)
    traits = _traits("x")
    score = " + ".join(["element_at(_w, '')", *[f"coalesce(try_element_at(_w, {traits[f]}), 0.0D)" for f in FEATURES]])
    spans = spans.withColumn("private", F.expr(f"filter(candidates, x -> {score} >= {math.log(SURE / (1 - SURE))}D)"))

    def listed(kinds: tuple[str, ...]) -> Column:
        each = [F.expr(f"transform({k}, x -> named_struct('s', x.s, 'k', {n}, 'o', concat('{k}:', x.s, ':', x.e)))") for n, k in enumerate(KINDS) if k in kinds]
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x.o), ",")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(tuple(PATTERNS)), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))
