"""URL filters: host-suffix and path-prefix expressions, hashed-prefix equi-join, rule precedence.

Each URL is expanded into the (host suffix, path prefix) expressions whose
shape (number of host labels, path length) occurs in the rule list. The
expressions meet the rules in an equi-join on the first four bytes of their
SHA-256; the full digest then confirms the match and the longest rule wins.

Only built-in functions are used. Distinct (host, path) pairs are judged once,
so a URL that a third of all rows share is pre-aggregated before the shuffle,
and the join back leaves a hot key to the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path) of the standing rule list.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hex digits of the digest prefix that the equi-join uses.
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.when(url.contains("://"), F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.when(url.contains("://"), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path. Precedence: the longer host plus path, then the longer host,
    then ``block`` before ``allow``, then the smaller rule text. Without a rule
    the verdict is ``default``.

    Null URLs and those without ``://`` have an empty host and path and get
    the default. Repeated rows stay, an empty table gives an empty result, and
    input columns named host, path, rule or verdict are replaced. Rules with
    a null part are ignored.
    """
    rules = rules.where("action is not null and host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")
    ).dropDuplicates()
    # The distinct shapes are bounded by label count times path length, not by the number of rules.
    shapes = [tuple(x) for x in rules.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()]
    out = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    out = out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").alias("b"), F.col("r_host"), F.col("r_path"), F.col("r_action"))
    hashed = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX))
    labels = F.size(F.split("host", r"\."))
    expressions = F.filter(
        F.array(*[
            F.when((labels >= k) & (F.length("path") >= n), _digest(F.substring_index("host", ".", -k), F.substring("path", 1, n) if n else F.lit("")))
            for k, n in sorted(shapes)
        ]),
        lambda x: x.isNotNull(),
    )
    m_host, m_path = fresh("_host", out), fresh("_path", out)
    urls = out.select("host", "path").where("host <> ''").distinct()
    matched = (
        urls.select("host", "path", F.explode(expressions).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .join(broadcast_if_small(hashed), (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")))
        .groupBy("host", "path")
        .agg(F.max(best).alias("best"))
        .select(F.col("host").alias(m_host), F.col("path").alias(m_path), F.concat("best.r_host", "best.r_path").alias("rule"), F.col("best.r_action").alias("verdict"))
    )
    return (
        out.join(matched, (F.col("host") == F.col(m_host)) & (F.col("path") == F.col(m_path)), "left")
        .drop(m_host, m_path)
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, row_number() OVER () AS k,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, k,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(action, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                             ('allow','com','/fr/'), ('block','com','/de/')),
m AS (
  SELECT k, action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY k ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, action DESC, rhost, rpath) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (k)
"""
