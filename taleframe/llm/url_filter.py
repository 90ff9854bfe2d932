"""Host-suffix and path-prefix URL rules, matched through short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taleframe.llm.common import lower_ascii, read

#: Fixed rules of the query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SHORT = 8


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _digests(expression: Column) -> Column:
    digest = F.sha2(expression, 256)
    return F.struct(F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"))


def _expressions(host: Column, path: Column, labels: int, depth: int, lengths: list[int]) -> Column:
    """Every host suffix of at most ``labels`` labels with every path prefix that a rule can have."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), n - labels + 1), n),
        lambda i: F.array_join(F.slice(parts, i, n), "."),
    )
    steps = F.slice(F.split(path, "/"), 1, depth + 1)
    whole = F.transform(
        F.when(F.size(steps) > 1, F.sequence(F.lit(1), F.size(steps) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")),
    )
    cut = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(path)),
        lambda k: F.substring(path, F.lit(1), k),
    )
    prefixes = F.array_union(whole, cut)
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge each row's url: columns page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the url's path starts with the rule's path.  The longest
    rule (host and path together) wins, then the longer host, then a block.  A url that no rule fits gets
    ``default`` and a null rule.  A null url, or one without ``://``, has empty host and path and fits no
    rule.  Repeated rows stay repeated; other columns of ``pages`` are ignored; rules with a null are
    ignored.  Only distinct (host, path) pairs are expanded, so a hot url is matched once.
    """
    rules = rules.where("verdict is not null and host is not null and path is not null").select(
        "verdict", lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path")
    )
    most = rules.agg(
        F.max(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("depth"),
        F.sort_array(F.collect_set(F.when(~F.endswith("rule_path", F.lit("/")), F.length("rule_path")))).alias("lengths"),
    ).first()
    host, path = url_host_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    names = judged.where("host <> ''").select("host", "path").distinct()
    each = names.select(
        "host",
        "path",
        F.explode(_expressions(F.col("host"), F.col("path"), most["labels"] or 1, most["depth"] or 0, most["lengths"])).alias("expression"),
    ).withColumn("key", _digests(F.col("expression")))
    keyed = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_key", _digests(F.col("rule")))
    hits = each.join(keyed, F.col("key.short") == F.col("rule_key.short")).where("key.digest = rule_key.digest")
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length("rule").alias("length"),
                F.length("rule_host").alias("host_length"),
                (F.col("verdict") == "block").alias("blocks"),
                F.col("rule").alias("rule"),
                F.col("verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the url of every row of pages, by the five fixed rules; ``allow`` where none fits.

    A null url, or one without ``://``, has empty host and path and fits no rule; urls of any length are read whole; the longest
    rule wins; repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    return filter_urls(read(spark, sf_dir, "pages"), rule_table(spark))


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP9_SQL = f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {_SQL_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
judged AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
hits AS (
  SELECT n, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, r.verdict = 'block' DESC) AS k
  FROM judged j JOIN rules r ON (j.host = rule_host OR ends_with(j.host, '.' || rule_host)) AND starts_with(j.path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM judged LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)
"""
