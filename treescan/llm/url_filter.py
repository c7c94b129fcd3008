"""URL rules by host suffix and path prefix.

A url expands to pairs of a host suffix and a path prefix. Both a rule and a pair have a SHA-256
digest; they are joined on its first eight hex digits, the whole digest confirms, and the
longest confirmed rule wins. Only suffixes with as many labels, and prefixes as long, as some
rule has are made, which loses none.

DataFrame functions only. The rules are broadcast up to `BROADCAST_RULES` of them (counted);
beyond, both sides are exchanged by hash prefix and a salt, so a domain with a third of all urls
spreads over `SALTS` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES, SALTS = 100_000, 32
DIGITS = 8


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of `pages` with ``host, path, rule, verdict``; columns of these names are replaced.

    rules: ``host, path, verdict`` (``allow`` or ``block``). A rule fits a url whose host is the
    rule's or ends in a dot and it, and whose path starts with the rule's. The longest rule
    (host and path together) wins, of equally long ones that with the longer host; if one rule is
    given with both verdicts it blocks. Rules with an empty or null host or a null path fit
    nothing. Where none fits, rule is null and the verdict `default`. A null url, or one without
    ``://``, has an empty host and path. Repeated rows are judged one by one.
    """
    rules = rules.where("host != '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select("host", "path", "verdict", F.sha2(F.concat_ws("\0", "host", "path"), 256).alias("digest"))
    shape = rules.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    given = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), given, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>"), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("s"), p.alias("p")))))
    tried = rows.withColumn("pair", F.explode_outer(pairs)).withColumn("full", F.sha2(F.concat_ws("\0", "pair.s", "pair.p"), 256))
    tried = tried.withColumn("start", F.when(F.col("pair").isNotNull(), F.substring("full", 1, DIGITS)))
    listed = rules.select(
        F.substring("digest", 1, DIGITS).alias("start"), "digest",
        F.struct(F.length(F.concat("host", "path")), F.length("host"), F.concat("host", "path").alias("rule"), "verdict").alias("found"),
    )
    if shape["n"] <= BROADCAST_RULES:
        hit = tried.join(F.broadcast(listed), "start", "left")
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = tried.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["start", "salt"], "left")
    # a row's pairs are neighbours, so the map side leaves one line for each
    best = hit.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("given", "host", "path")],
        F.max(F.when(F.col("full") == F.col("digest"), F.col("found"))).alias("found"),
    )
    return best.select("given.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS rules(host, path, verdict)")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP1_SQL = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
),
hits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (n)
"""
