"""Operator 3: URL filtering by rules and by empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted by host. A host's bad rate is shrunk towards its registered domain's, that towards
its suffix's, that towards the whole table's; the strength of each step is the beta-binomial fit, by moments, of the spread between
siblings. A page is blocked where the lower bound of its host's posterior rate passes ``most_bad``: with one half and z of 1.645, where the odds are 19 to 1 that most of its host's
pages are bad. Rules come first.

Rows: a null URL, or one without ``://``, has an empty host and path and gets the whole table's rate; hosts without labels get their
domain's, and so on up; repeated URLs are separate rows with equal results; outcomes with a null host or flag are ignored; an empty table
gives no row. Columns named ``host``, ``path``, ``rule``, ``verdict``, ``bad_rate`` or ``bad_bound`` are replaced, other columns kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; of all others the suffix is the last label. A parameter of the operator.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/"))
#: Bounds of a prior's strength, in labelled pages.
WEAKEST, STRONGEST = 1.0, 10_000.0

ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), b AS (
  SELECT doc_id, max(CAST(toxic = 1 OR quality = 0 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), o AS (
  SELECT host, bad FROM (SELECT host, regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1) AS no FROM u) JOIN b ON no <> '' AND CAST(nullif(no, '') AS BIGINT) = doc_id WHERE bad IS NOT NULL
), parts AS (
  SELECT host, CASE WHEN array_to_string(a[-2:], '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') THEN 1 ELSE 0 END AS x, a FROM (SELECT DISTINCT host, string_split(host, '.') AS a FROM u)
), named AS (
  SELECT host, array_to_string(CASE WHEN x = 1 THEN a[-3:] ELSE a[-2:] END, '.') AS domain, array_to_string(CASE WHEN x = 1 THEN a[-2:] ELSE a[-1:] END, '.') AS suffix FROM parts
), h AS (SELECT host, domain, suffix, count(*) AS n, sum(bad)::DOUBLE AS bad FROM o JOIN named USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
levels AS (SELECT 'h' AS level, n::DOUBLE AS n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
moments AS (SELECT level, count(*) AS m, sum(n) AS n, sum(bad) / sum(n) AS r, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM levels GROUP BY level),
spreads AS (SELECT *, r * (1 - r) AS noise, bb / n - r * r - r * (1 - r) * (m - 1) / n AS spread, 1 - nn / (n * n) AS room FROM moments),
strengths AS (SELECT level, CASE WHEN m < 2 OR noise <= 0 OR spread <= 0 OR room <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, noise * room / spread - 1)) END AS k FROM spreads),
ks AS (SELECT coalesce(max(k) FILTER (level = 'h'), 10000.0) AS kh, coalesce(max(k) FILTER (level = 'd'), 10000.0) AS kd, coalesce(max(k) FILTER (level = 's'), 10000.0) AS ks FROM strengths),
root AS (SELECT CASE WHEN count(*) > 0 THEN (sum(bad) + 1) / (count(*) + 2) ELSE 0 END AS r0 FROM o),
s1 AS (SELECT suffix, (bad + r0 * ks) / (n + ks) AS r, n + ks AS size FROM s, ks, root),
d1 AS (SELECT domain, (d.bad + s1.r * kd) / (d.n + kd) AS r, d.n + kd AS size FROM d JOIN s1 USING (suffix), ks),
h1 AS (SELECT host, (h.bad + d1.r * kh) / (h.n + kh) AS r, h.n + kh AS size FROM h JOIN d1 USING (domain), ks),
judged AS (
  SELECT host, coalesce(h1.r, d1.r, s1.r, r0) AS r, CASE WHEN h1.r IS NOT NULL THEN h1.size WHEN d1.r IS NOT NULL THEN d1.size WHEN s1.r IS NOT NULL THEN s1.size ELSE ks END AS size
  FROM named LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), ks, root
), rules(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'example.net', '/de/8'), ('allow', 'net', '/de/'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN r - 1.645 * sqrt(r * (1 - r) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM u JOIN judged USING (host) LEFT JOIN fit USING (page_id)
"""


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    host = F.regexp_extract(F.substring(url, F.length(rest) + 4, F.length(url)), r"^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    path = F.regexp_extract(F.substring(url, F.length(rest) + 4, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def suffix_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    pair = F.substring_index(host, ".", -2)
    return F.when(pair.isin(*two_labels), pair).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; the first of equally long ones."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def strength(children: DataFrame) -> float:
    """Beta-binomial prior strength from rows (n, bad), by moments of the spread of their rates."""
    r = children.agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")
    ).first()
    if not r["n"] or r["m"] < 2:
        return STRONGEST
    rate = r["bad"] / r["n"]
    noise = rate * (1 - rate)
    spread = r["bb"] / r["n"] - rate * rate - noise * (r["m"] - 1) / r["n"]
    room = 1 - r["nn"] / r["n"] ** 2
    if noise <= 0 or spread <= 0 or room <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, noise * room / spread - 1))


def reputations(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """From rows (host, bad): posterior rate and bound by host, by domain and by suffix, and for the rest of the world.

    One pass over the outcomes sums them by host before the shuffle into a table in the shared folder; what follows reads that, a row per labelled host.
    """
    hosts = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = staged(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "host-outcomes")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    root = (total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.0
    by_suffix, by_domain, by_host = (strength(x) for x in (suffixes, domains, hosts))

    def posterior(rows: DataFrame, prior: Column, k: float) -> DataFrame:
        size = F.col("n") + k
        rate = (F.col("bad") + prior * k) / size
        return rows.withColumn("bad_rate", rate).withColumn("bad_bound", F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (size + 1)))

    suffixes = posterior(suffixes, F.lit(root), by_suffix).select("suffix", "bad_rate", "bad_bound")
    up = suffixes.select("suffix", F.col("bad_rate").alias("up"))
    domains = posterior(domains.join(up, "suffix"), F.col("up"), by_domain).select("domain", "bad_rate", "bad_bound")
    up = domains.select("domain", F.col("bad_rate").alias("up"))
    hosts = posterior(hosts.join(up, "domain"), F.col("up"), by_host).select("host", "bad_rate", "bad_bound")

    def alone(k: float) -> float:
        return root - z * (root * (1 - root) / (k + 1)) ** 0.5

    return hosts, domains, suffixes, (root, alone(by_suffix))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict, bad_rate and bad_bound. ``outcomes``: host, bad (boolean), a row per labelled page.

    Distinct hosts of the pages are judged once; pages then look theirs up. The join has a row per host on one side, so Spark
    broadcasts that side where its measured size allows and splits a hot host's partition otherwise.
    """
    hosts, domains, suffixes, (root, floor) = reputations(outcomes, z)
    plain = pages.drop("host", "path", "rule", "verdict", "bad_rate", "bad_bound")
    pages = plain.withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "path": path_of(F.coalesce("url", F.lit("")))})
    known = pages.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    named = [(hosts, "host", "h"), (domains, "domain", "d"), (suffixes, "suffix", "s")]
    for table, key, mark in named:
        known = known.join(table.select(key, F.struct("bad_rate", "bad_bound").alias(mark)), key, "left")
    default = F.struct(F.lit(root).alias("bad_rate"), F.lit(floor).alias("bad_bound"))
    known = known.select("host", F.coalesce("h", "d", "s", default).alias("r"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.join(known, "host").withColumn("rule__", rule)
    verdict = F.coalesce(F.col("rule__.action"), F.when(F.col("r.bad_bound") > most_bad, "block").otherwise("allow"))
    return judged.select(*plain.columns, "host", "path", F.col("rule__.rule").alias("rule"), verdict.alias("verdict"), "r.bad_rate", "r.bad_bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose URL's path ends in the number of a labelled document: bad is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")) == 1
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"))
    linked = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull())
    return linked.join(known, "doc_id").select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_url_reputation: host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    outcomes = labelled_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
