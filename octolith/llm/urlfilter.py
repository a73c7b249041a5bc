"""URL filter by rules and empirical-Bayes host reputation (operator 8), DataFrame operations only.

Reputation: labelled pages are good or bad.  Their outcomes are summed per host, registered domain and
suffix (partial aggregation, one row per host then).  Each level's beta prior has the posterior mean of
the level above and a strength that the level's own spread gives (method of moments: the between-host
variance beyond binomial noise); the suffixes shrink to the overall rate.  A host is blocked when the upper bound
of its posterior rate of good pages lies below the floor: ``FLOOR``, or what the bounds themselves give if that is higher, the highest step of 1/``STEPS``
under which lie hosts with at most a share of ``WORST`` of the labelled pages.  So hosts that are mostly bad go however many they are, and else the hosts of the
worst reputation up to that share, none where all are alike; a host without evidence is allowed.

Registered domain: the last two labels of the host without its port, three where a country's suffix has two labels (``SECOND_LEVEL`` before two
letters); an IPv4 address is a domain and a suffix of its own.

Rules come first: a rule (host, path prefix) fits its host and all subdomains; the longest wins.  Up to ``MOST_RULES`` rules are compiled into the plan;
more become a table that meets the suffixes of the hosts in a join, with the same result.

Nulls: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged like a host without labels.
Null labels are no labels.  Repeated pages count once each; repeated labels of an id count once, good only if
all of them are.  Equally long rules: the first in the list wins.  Empty tables give empty results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import ascii_lower, materialize, table

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FLOOR, WORST, STEPS, SIGMAS, WEAKEST, STRONGEST = 0.5, 0.1, 4096, 2.0, 1.0, 1000.0
MOST_RULES = 1000
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The winning rule (host and path together) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def match_table(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and verdict to rows (host, path): any number of rules, by a join with the suffixes of each host."""
    known = rows.sparkSession.createDataFrame([(what, h, p, len(h + p), -k) for k, (what, h, p) in enumerate(rules)], "_verdict string, _rhost string, _rpath string, _size int, _first int")
    pairs = rows.select(F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    tails = F.expr("transform(sequence(1, size(split(_h, '[.]'))), i -> substring_index(_h, '.', -i))")
    fits = pairs.select("_h", "_p", F.explode(F.array_distinct(tails)).alias("_tail")).join(known, (F.col("_tail") == F.col("_rhost")) & F.startswith("_p", "_rpath"))
    best = fits.groupBy("_h", "_p").agg(F.max(F.struct("_size", "_first", F.concat("_rhost", "_rpath").alias("rule"), "_verdict")).alias("_best"))
    best = materialize(best, "rules")  # the pages' side of the join is a plain shuffle then, which Spark can split
    out = rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.col("_best._verdict")}).drop("_h", "_p", "_best")


def _strength(m: int, k: int | None, g: int | None, kk: int | None, gg: int | None) -> float:
    """Pages that a level's prior is worth, by the method of moments; the weakest prior where the spread is largest."""
    if not k:
        return STRONGEST
    p = g / k
    between, per = gg / (1 << 20) - p * g - (m - 1) * p * (1 - p), k - kk / k
    if between <= 0 or per <= 0:
        return STRONGEST
    return max(WEAKEST, min(STRONGEST, p * (1 - p) / (between / per) - 1))


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = name.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    alone = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")

    def last(labels: int) -> Column:
        return F.when(alone, name).when(two, F.substring_index(name, ".", -labels - 1)).otherwise(F.substring_index(name, ".", -labels))

    return last(2), last(1)


def floor_of(known: DataFrame, worst: float) -> float:
    """The highest step under which lie hosts with at most a share of ``worst`` of the labelled pages; FLOOR at least."""
    steps = known.groupBy(F.floor(F.col("upper") * STEPS).alias("k")).agg(F.sum("n").alias("n")).collect()  # STEPS + 1 rows at most
    total, seen = sum(r.n for r in steps), 0
    for r in sorted(steps, key=lambda r: r.k):
        seen += r.n
        if seen > worst * total:
            return max(FLOOR, r.k / STEPS)
    return FLOOR


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, rate, upper) of rows (host, good, n): posterior mean and upper bound of each host's rate of good pages."""
    domain, suffix = domain_of(F.col("host"))
    rows = outcomes.withColumns({"domain": domain, "suffix": suffix})
    domains = rows.groupBy("suffix", "domain").agg(F.sum("good").alias("dg"), F.sum("n").alias("dn"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dg").alias("sg"), F.sum("dn").alias("sn"))

    def sums(level: DataFrame, name: str, good: str, n: str) -> DataFrame:
        """Whole numbers (2^-20 for the ratios), so that the order of the rows doesn't matter."""
        g, k = F.col(good), F.col(n)
        ratio = F.sum(F.floor(g * g * F.lit(float(1 << 20)) / k))
        return level.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("m"), F.sum(k).alias("k"), F.sum(g).alias("g"), F.sum(k * k).alias("kk"), ratio.alias("gg"))

    levels = {r.level: r for r in sums(rows, "host", "good", "n").union(sums(domains, "domain", "dg", "dn")).union(sums(suffixes, "suffix", "sg", "sn")).collect()}  # three rows
    kh, kd, ks = (_strength(levels[x].m, levels[x].k, levels[x].g, levels[x].kk, levels[x].gg) for x in ("host", "domain", "suffix"))
    overall = ((levels["host"].g or 0) + 1) / ((levels["host"].k or 0) + 2)
    by_suffix = suffixes.select("suffix", ((F.col("sg") + ks * overall) / (F.col("sn") + F.lit(ks))).alias("ps"))
    by_domain = domains.join(by_suffix, "suffix").select("suffix", "domain", ((F.col("dg") + F.lit(kd) * F.col("ps")) / (F.col("dn") + F.lit(kd))).alias("pd"))
    rated = rows.join(by_domain, ["suffix", "domain"])
    a, b = F.col("good") + F.lit(kh) * F.col("pd"), F.col("n") - F.col("good") + F.lit(kh) * (1 - F.col("pd"))
    mean = a / (a + b)
    return rated.select("host", "n", mean.alias("rate"), F.least(F.lit(1.0), mean + SIGMAS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, worst: float = WORST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``labels`` has (page_id, good): the outcomes to learn from.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = labels.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    seen = rows.select(F.col("page_id").alias("_p"), "host").join(once, F.col("_p") == F.col("page_id"))
    outcomes = materialize(seen.groupBy("host").agg(F.sum("good").cast("long").alias("good"), F.count(F.lit(1)).alias("n")), "outcomes")
    known = reputation(outcomes).filter("host <> ''")
    blocked = known.filter(F.col("upper") < floor_of(known, worst)).select(F.col("host").alias("_host"))
    if len(rules) <= MOST_RULES:
        rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": rule, "verdict": verdict})
    else:
        rows = match_table(rows, rules)
    out = rows.join(blocked, F.col("host") == F.col("_host"), "left")
    learnt = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", learnt).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its number: good where the quality is 1 and it isn't toxic."""
    good = F.col("quality").cast("int") * (1 - F.coalesce(F.col("toxic"), F.lit(0)).cast("int"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, min(quality * (1 - coalesce(toxic, 0))) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
t AS (SELECT host, name, CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){3}$') THEN 4 WHEN regexp_matches(name, '(^|\\.)(ac|co|com|edu|gov|net|org)\\.[a-z][a-z]$') THEN 3 ELSE 2 END AS k, good, n
      FROM (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n FROM p JOIN l ON p.page_id = l.doc_id GROUP BY host)),
h AS (SELECT host, array_to_string(string_split(name, '.')[-k:], '.') AS domain, array_to_string(string_split(name, '.')[-(CASE k WHEN 4 THEN 4 ELSE k - 1 END):], '.') AS suffix, good, n FROM t),
d AS (SELECT suffix, domain, sum(good) AS good, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY ALL),
z AS (SELECT level, count(*) AS m, sum(n) AS k, sum(good) AS g, sum(n * n) AS kk, sum(trunc(good * good * 1048576 / n)) AS gg
      FROM (SELECT 'h' AS level, good, n FROM h UNION ALL SELECT 'd', good, n FROM d UNION ALL SELECT 's', good, n FROM s) GROUP BY level),
b AS (SELECT level, g / k AS p, (gg / 1048576.0::DOUBLE - g / k * g - (m - 1) * (g / k) * (1 - g / k)) / nullif(k - kk / k, 0) AS between_ FROM z),
q AS (SELECT level, greatest(1.0::DOUBLE, least(1000.0::DOUBLE, coalesce(CASE WHEN between_ > 0 THEN p * (1 - p) / between_ - 1 ELSE 1000 END, 1000))) AS k FROM b),
rs AS (SELECT suffix, (good + (SELECT k FROM q WHERE level = 's') * (SELECT (sum(good) + 1) / (sum(n) + 2) FROM s)) / (n + (SELECT k FROM q WHERE level = 's')) AS r FROM s),
rd AS (SELECT d.suffix, domain, (good + (SELECT k FROM q WHERE level = 'd') * rs.r) / (n + (SELECT k FROM q WHERE level = 'd')) AS r FROM d JOIN rs USING (suffix)),
ab AS (SELECT host, n, good + (SELECT k FROM q WHERE level = 'h') * r AS a, n - good + (SELECT k FROM q WHERE level = 'h') * (1 - r) AS b FROM h JOIN rd USING (suffix, domain)),
bound AS (SELECT host, n, a / (a + b) + 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM ab WHERE host <> ''),
steps AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS total FROM (SELECT floor(least(1.0::DOUBLE, upper) * 4096) AS k, sum(n) AS n FROM bound GROUP BY 1)),
floor_ AS (SELECT greatest(0.5::DOUBLE, coalesce(min(k), 0) / 4096.0::DOUBLE) AS f FROM steps WHERE upto > 0.1::DOUBLE * total)
SELECT page_id, p.host, path, rule, coalesce(CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END,
       CASE WHEN upper < (SELECT f FROM floor_) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p) AS p
LEFT JOIN bound ON p.host = bound.host
"""
