"""URL filter: empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, rule): host, then path, of the block and allow list. Fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: A page passes if the posterior mean less Z deviations is at least this.
FLOOR, Z = 0.5, 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without '://'."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return (
        F.coalesce(F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.lit("")),
        F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")),
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _strength(counts: DataFrame, level: str, parent: str) -> DataFrame:
    """One row: how many pseudo-observations a parent's rate is worth to its children, by moments, from 1 to 1000."""
    c = counts.where("n > 0")
    rates = c.select(parent, F.col("n").cast("double").alias("n"), (F.col("k") / F.col("n")).alias("p"))
    each = rates.groupBy(parent).agg(
        F.count("*").alias("i"), F.sum("n").alias("w"), F.sum(F.col("n") * F.col("p")).alias("wp"),
        F.sum(F.col("n") * F.col("p") * F.col("p")).alias("wpp"), F.sum(1 / F.col("n")).alias("inv"),
    ).select(
        "i", "w", "inv", (F.col("wp") / F.col("w")).alias("m"), (F.col("wpp") / F.col("w")).alias("q")
    )
    total = each.agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("m") * (1 - F.col("m"))).alias("v"),
        F.sum(F.col("w") * (F.col("q") - F.col("m") * F.col("m"))).alias("s"),
        F.sum(F.col("w") * F.col("m") * (1 - F.col("m")) * F.col("inv") / F.col("i")).alias("noise"),
    )
    raw = F.when(F.col("s") > F.col("noise"), (F.col("v") - F.col("s")) / (F.col("s") - F.col("noise"))).otherwise(F.lit(1000.0))
    return total.select(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), raw)), F.lit(1000.0)).alias(f"m_{level}"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's reputation (mean, bound, n).

    pages has page_id and url; outcomes has page_id and good (0 or 1, null: no outcome), any number of rows a page. A
    page without host is judged by the overall rate alone. Without any outcome every rate is 0.5. Repeated page
    rows are judged each; other columns are ignored; an empty table gives no rows.

    Beta-binomial shrinkage goes down the levels: overall -> suffix -> registered domain -> host. Outcomes are summed
    map-side to one row a host before anything else moves, so a host with a third of all pages is one row. Pages meet
    their host's row in one join whose hot keys Spark splits.
    """
    host, path = url_parts(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = outcomes.where("good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    labels = F.split("name", r"\.")
    width = F.when(F.substring_index("name", ".", -2).isin(*TWO_LABELS), 2).otherwise(1)
    hosts = (
        rows.join(judged, "page_id", "left")
        .groupBy("host").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k"))
        .withColumn("name", F.regexp_replace("host", r":\d*$", ""))
        .withColumn("suffix", F.when(width == 2, F.substring_index("name", ".", -2)).otherwise(F.substring_index("name", ".", -1)))
        .withColumn("domain", F.when(F.size(labels) <= width, F.col("name")).when(width == 2, F.substring_index("name", ".", -3)).otherwise(F.substring_index("name", ".", -2)))
        .withColumn("world", F.lit("world"))
    )
    domains = hosts.groupBy("domain", "suffix", "world").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix", "world").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    world = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("overall"))
    strengths = world.crossJoin(_strength(suffixes, "suffix", "world")).crossJoin(_strength(domains, "domain", "suffix")).crossJoin(_strength(hosts, "host", "domain"))

    def shrunk(n: str, k: str, m: str, prior: str) -> Column:
        return (F.col(m) * F.col(prior) + F.col(k)) / (F.col(m) + F.col(n))

    # one row of strengths: four numbers
    s = suffixes.crossJoin(F.broadcast(strengths)).select("suffix", "m_domain", "m_host", shrunk("n", "k", "m_suffix", "overall").alias("of_suffix"))
    d = domains.join(s, "suffix").select("domain", "suffix", "m_host", shrunk("n", "k", "m_domain", "of_suffix").alias("of_domain"))
    h = hosts.join(d, ["domain", "suffix"]).select("host", "n", "m_host", shrunk("n", "k", "m_host", "of_domain").alias("mean"))
    h = h.withColumn("bound", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("m_host") + F.col("n") + 1)))
    method = F.when(F.col("bound") >= floor, F.lit("allow")).otherwise(F.lit("block"))
    return rows.join(h, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"),
        F.round("mean", 9).alias("mean"), F.round("bound", 9).alias("bound"), F.col("n").alias("n_outcomes"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality label of the document that a page's path numbers; pages whose path has no number have none."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS bigint)")
    keyed = pages.select("page_id", number.alias("doc_id")).where("doc_id is not null")
    return keyed.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


SQL = r"""
WITH u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path,
    try_cast(nullif(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1), '') AS bigint) AS doc_id
  FROM pages
), o AS (
  SELECT u.page_id, count(*) AS n, sum(l.quality) AS k FROM u JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY 1
), h0 AS (
  SELECT host, sum(coalesce(n, 0)) AS n, sum(coalesce(k, 0)) AS k, regexp_replace(host, ':[0-9]*$', '') AS name FROM u LEFT JOIN o USING (page_id) GROUP BY host
), h1 AS (
  SELECT *, string_split(name, '.') AS a, CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') THEN 2 ELSE 1 END AS w FROM h0
), h AS (
  SELECT host, n, k, array_to_string(a[-w:], '.') AS suffix, CASE WHEN len(a) <= w THEN name ELSE array_to_string(a[-w - 1:], '.') END AS domain FROM h1
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL
), g AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS overall FROM s
), c AS (
  SELECT 'suffix' AS level, 'world' AS parent, n::double AS n, k / n AS p FROM s WHERE n > 0
  UNION ALL SELECT 'domain', suffix, n, k / n FROM d WHERE n > 0
  UNION ALL SELECT 'host', domain, n, k / n FROM h WHERE n > 0
), e AS (
  SELECT level, count(*) AS i, sum(n) AS w, sum(1 / n) AS inv, sum(n * p) / sum(n) AS m, sum(n * p * p) / sum(n) AS q FROM c GROUP BY level, parent
), t AS (
  SELECT level, sum(w * m * (1 - m)) AS v, sum(w * (q - m * m)) AS s, sum(w * m * (1 - m) * inv / i) AS noise FROM e GROUP BY level
), x AS (
  SELECT level, greatest(1.0, least(1000.0, CASE WHEN s > noise THEN (v - s) / (s - noise) ELSE 1000.0 END)) AS m FROM t
), sm AS (
  SELECT suffix, (coalesce((SELECT m FROM x WHERE level = 'suffix'), 1000.0) * overall + k) / (coalesce((SELECT m FROM x WHERE level = 'suffix'), 1000.0) + n) AS of_suffix FROM s, g
), dm AS (
  SELECT domain, suffix, (coalesce((SELECT m FROM x WHERE level = 'domain'), 1000.0) * of_suffix + k) / (coalesce((SELECT m FROM x WHERE level = 'domain'), 1000.0) + n) AS of_domain FROM d JOIN sm USING (suffix)
), hm AS (
  SELECT host, n, coalesce((SELECT m FROM x WHERE level = 'host'), 1000.0) AS m, (coalesce((SELECT m FROM x WHERE level = 'host'), 1000.0) * of_domain + k) / (coalesce((SELECT m FROM x WHERE level = 'host'), 1000.0) + n) AS mean
  FROM h JOIN dm USING (domain, suffix)
), hb AS (SELECT host, n, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (m + n + 1)) AS bound FROM hm
), rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict,
       round(mean, 9) AS mean, round(bound, 9) AS bound, hb.n::bigint AS n_outcomes
FROM u LEFT JOIN f USING (page_id) LEFT JOIN hb ON hb.host = u.host
"""
