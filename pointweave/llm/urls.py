"""URL filter: host-suffix and path-prefix expressions joined with a rule list.

Every URL is expanded into all pairs of a host suffix (cut at dots) and a path
prefix (cut after slashes). Rules are listed under the same kind of expression.
The equi-join is on the first 32 bits of the expression's SHA-256, and a match
counts only when the full digests agree and the URL's path starts with the whole
path of the rule. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import folded, unfolded
from pointweave.session import cut

#: fixed values: the rules of the registered query (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
SCHEMA = "verdict string, rule_host string, rule_path string"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://`` or for a null."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, SCHEMA)


def _upto_last_slash(path: str) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path of the rule that won, or null) and ``verdict``.

    ``rules`` has verdict, rule_host and rule_path. A rule fits its host and all
    subdomains when the URL's path starts with the rule's path. Of several the
    longest (host and path together) wins, then the longest host, then ``block``.
    URLs without a rule get ``default``. Null and odd URLs have an empty host,
    which no rule fits. Columns of ``df`` with the names of the results give way;
    repeated rows and an empty table are fine.
    """
    host, path = split_url(url_col)
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in df.columns if c not in made]
    split = folded(df, host.alias("_host"), path.alias("_path"), columns=kept)
    rules = cut(
        rules.where("rule_host is not null and rule_path is not null").select(
            "verdict",
            F.translate("rule_host", UPPER, LOWER).alias("rule_host"),
            "rule_path",
            F.size(F.split("rule_host", r"\.")).alias("_labels"),
            (F.size(F.split("rule_path", "/")) - 1).alias("_slashes"),
            F.sha2(F.concat_ws("\n", F.translate("rule_host", UPPER, LOWER), _upto_last_slash("rule_path")), 256).alias("_full"),
        ),
        "rules",
    )
    # no expression deeper than the deepest rule can match, so none is made
    deepest = rules.agg(F.coalesce(F.max("_labels"), F.lit(0)), F.coalesce(F.max("_slashes"), F.lit(0))).first()
    hosts = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(hosts), F.lit(max(1, deepest[0])))),
        lambda n: F.array_join(F.slice(hosts, F.size(hosts) - n + 1, n), "."),
    )
    parts = F.split("_path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(deepest[1]))),
        lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )
    # one row per distinct place: pages of a busy site are judged once
    places = split.where("_host <> ''").select("_host", "_path").distinct()
    expressions = (
        places.select("_host", "_path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
        .select("_host", "_path", "_suffix", F.explode("_prefixes").alias("_prefix"))
        .select("_host", "_path", F.sha2(F.concat_ws("\n", "_suffix", "_prefix"), 256).alias("_digest"))
        .withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    )
    found = (
        expressions.join(rules.withColumn("_short", F.substring("_full", 1, PREFIX_HEX)), "_short")
        .where((F.col("_digest") == F.col("_full")) & F.startswith("_path", "rule_path"))
        .groupBy("_host", "_path")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("all"),
                    F.length("rule_host").alias("host"),
                    (F.col("verdict") == "block").alias("strict"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    F.col("verdict").alias("verdict"),
                )
            ).alias("_best")
        )
    )
    judged = split.join(cut(found, "verdicts"), ["_host", "_path"], "left")
    return judged.select(
        *unfolded(kept),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = f"""
WITH r(verdict, rh, rp) AS (VALUES {", ".join(map(str, RULES))}),
u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
   ORDER BY length(rh) + length(rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
   ORDER BY length(rh) + length(rp) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
