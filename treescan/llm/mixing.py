"""Mixing sources to target weights.

Budgets go down a tree of domain, language and source. Among siblings, a budget is dealt by
weight, and what a node can't fill (its subtree's tokens times the epochs allowed) goes to its
siblings by their weights; only if all siblings are full does the shortage show at their
parent, which is then short itself. That is water-filling per level from the top with the
capacities of whole subtrees, in closed form over siblings sorted by capacity per weight.

A leaf with budget b and t tokens takes its documents ``b div t`` times whole, and of the next
epoch a prefix of ``b mod t`` tokens in that epoch's seeded order (MD5 of seed, epoch and doc_id).
The prefix's end is found by hash digits: token sums per leaf and leading digits show the
one group in which it lies, twice over, and only that group is ordered. No leaf is gathered or
sorted as a whole, and texts never move.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their budgets are broadcast; beyond, they are joined.
BROADCAST_LEAVES = 100_000
_WORD = r"[^ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def name_of(col: Column) -> Column:
    """A level's name; null is a name of its own."""
    return F.coalesce(col.cast("string"), F.lit("(null)"))


def filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each node from ``parent_budget, weight, capacity`` among nodes of one parent."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_ratio = siblings.orderBy("ratio", *LEVELS[: len(parent) + 1])
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    n = n.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("double"))
    n = n.withColumn("weights", F.sum("weight").over(rest))
    # full: the level at which the rest would stand is above the node's own; they come first in the order
    n = n.withColumn("level", F.when(F.col("weights") > 0, (F.col("parent_budget") - F.col("used")) / F.col("weights")))
    n = n.withColumn("full", F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False)))
    n = n.withColumn("share", F.min(F.when(~F.col("full"), F.struct("ratio", "used", "weights", "level"))).over(siblings)["level"])
    budget = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * F.coalesce("share", F.lit(0.0)))
    return n.withColumn("budget", F.greatest(F.lit(0.0), budget)).drop("ratio", "used", "weights", "level", "full", "share")


def budgets(leaves: DataFrame, weights: DataFrame, total: int, epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` (whole tokens) for ``domain, lang, source, tokens``.

    weights: ``domain, lang, source, weight``; a node's row has nulls below its level. Nodes
    without a row weigh 1, negative weights 0.
    """
    nodes, known = None, []
    sizes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for k, level in enumerate(LEVELS):
        path = [*known, level]
        level_nodes = sizes.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        own = weights.where(" and ".join([*(f"{c} is not null" for c in path), *(f"{c} is null" for c in LEVELS[k + 1 :])]))
        own = own.groupBy(*path).agg(F.max("weight").alias("weight"))
        level_nodes = level_nodes.join(own, path, "left").withColumn("weight", F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(1.0))))
        if nodes is None:
            level_nodes = level_nodes.withColumn("parent_budget", F.lit(float(total)))
        else:
            level_nodes = level_nodes.join(nodes.select(*known, F.col("budget").alias("parent_budget")), known)
        nodes, known = filled(level_nodes, known), path
    # budgets are whole tokens; an excess of 1e-6 is rounding of doubles
    return nodes.join(leaves, list(LEVELS)).select(*LEVELS, "tokens", F.least(F.floor(F.col("budget") + 1e-6), F.col("capacity")).cast("long").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, weights: DataFrame, domain: Column, total: int | None = None, epochs: int = 4, seed: int = 1, names: tuple[str, ...] = ("epoch", "taken_tokens")) -> DataFrame:
    """The chosen rows of `docs`: its columns, ``epoch`` (from 0) and ``taken_tokens``.

    docs: ``doc_id, text, lang, source`` and others. Tokens are words between white space. total:
    tokens wanted (default: as many as `docs` has). A document at the end of a leaf's budget is
    taken in part: taken_tokens tells how many of its words; its text and ``n_chars`` are cut
    to them. Null languages and sources are names of their own; null and empty texts have no
    tokens and come along with their leaf's order. Rows of a leaf with one doc_id stand at one
    place of the order and are each cut at what is left there, so such repeats may exceed the
    budget by their tokens. An empty table gives no rows. Columns called like `names` are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in names]
    level = {"domain": name_of(domain), "lang": name_of(F.col("lang")), "source": name_of(F.col("source"))}
    light = written(docs.select(*[level[c].alias(c) for c in LEVELS], "doc_id", word_count(F.col("text")).alias("n")))
    leaves = written(light.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")))
    sums = leaves.agg(F.count("*").alias("k"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    total = sums["t"] if total is None else total
    hint = F.broadcast if sums["k"] <= BROADCAST_LEAVES else (lambda df: df)
    plan = budgets(leaves, weights, total, epochs)
    plan = written(plan.select(*LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int").alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("left")))
    # the end of each leaf's last, partial epoch
    keyed = light.join(hint(plan.where(F.col("left") > 0)), list(LEVELS)).withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
    fixed: list[str] = []
    for a, b in ((1, 2), (3, 2)):
        digits = f"d{a}"
        keyed = keyed.withColumn(digits, F.substring("key", a, b))
        groups = keyed.groupBy(*LEVELS, *fixed, "left", digits).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy(digits))
        ends = groups.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        ends = written(ends.select(*LEVELS, *fixed, digits, (F.col("left") - (F.col("upto") - F.col("n"))).alias("still")))
        fixed.append(digits)
        keyed = keyed.drop("left").join(hint(ends), [*LEVELS, *fixed]).withColumnRenamed("still", "left")
    at = keyed.groupBy(*LEVELS, "left", "key").agg(F.sum("n").alias("n"))
    at = at.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")))
    at = at.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    ends = at.select(*LEVELS, F.col("key").alias("end_key"), (F.col("left") - (F.col("upto") - F.col("n"))).alias("end_tokens"))
    plan = written(plan.select(*LEVELS, "whole").join(ends, list(LEVELS), "left"))
    # every document against its leaf's plan
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), *[level[c].alias(c) for c in LEVELS], word_count(F.col("text")).alias("n"))
    rows = rows.join(hint(plan), list(LEVELS))
    key = order_key(seed, F.col("whole"), F.col("given.doc_id"))
    last = F.when(key < F.col("end_key"), F.col("n")).when(key == F.col("end_key"), F.least("n", "end_tokens"))
    rows = rows.withColumn("last", last)
    count = F.col("whole") + F.when(F.col("last").isNotNull(), 1).otherwise(0)
    rows = rows.where(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumn("taken_tokens", F.when(F.col("epoch") < F.col("whole"), F.col("n")).otherwise(F.col("last")))
    cut = F.when(F.col("taken_tokens") < F.col("n"), F.array_join(F.slice(F.regexp_extract_all(F.col("given.text"), F.lit(_WORD), 0), F.lit(1), F.col("taken_tokens").cast("int")), " ")).otherwise(F.col("given.text"))
    rows = rows.withColumn("cut", cut)
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("taken_tokens") < F.col("n"), F.length("cut").cast("long")).otherwise(F.col("given.n_chars")) if "n_chars" in keep else None}
    out = [(new[c] if c in new else F.col(f"given.`{c}`")).alias(c) for c in keep]
    return rows.select(*out, F.col("epoch").alias(names[0]), F.col("taken_tokens").alias(names[1]))


#: The mix of the query: sources whose number leaves 0, 1, 2 on division by 3 are the domains web, books and code.
TARGET = [("web", None, None, 5.0), ("books", None, None, 3.0), ("code", None, None, 2.0), ("web", "en", None, 2.0), ("books", "en", None, 2.0), ("code", "en", None, 3.0), ("web", "en", "src0", 4.0)]
DOMAINS, EPOCHS, SEED = ("web", "books", "code"), 4, 17


def domain_of() -> Column:
    number = F.pmod(F.coalesce(F.nullif(F.regexp_extract(F.col("source"), r"(\d{1,9})$", 1), F.lit("")).cast("int"), F.lit(0)), F.lit(3))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), number + 1)


def target(spark) -> DataFrame:
    rows = ", ".join("(" + ", ".join("CAST(NULL AS STRING)" if v is None else f"{v!r}" if isinstance(v, str) else f"{v}D" for v in row) + ")" for row in TARGET)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS target(domain, lang, source, weight)")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, target(spark), domain_of(), epochs=EPOCHS, seed=SEED).select("doc_id", "lang", "source", "epoch", "taken_tokens")


def _sql() -> str:
    """The same in SQL, level by level."""
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    values = ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in TARGET)
    domains = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
    sql = f"""
WITH w(domain, lang, source, weight) AS (VALUES {values}),
d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    {domains}[1 + coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 3] AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '{word}')), 0) AS BIGINT) AS n
  FROM documents
),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY ALL),
total AS (SELECT CAST(coalesce(sum(tokens), 0) AS DOUBLE) AS total FROM leaves)"""
    for k in range(len(LEVELS)):
        path = ", ".join(LEVELS[: k + 1])
        known = ", ".join(LEVELS[:k])
        on = " AND ".join(f"w.{c} = s.{c}" for c in LEVELS[: k + 1]) + "".join(f" AND w.{c} IS NULL" for c in LEVELS[k + 1 :])
        names = ", ".join(f"s.{c}" for c in LEVELS[: k + 1])
        by = f"PARTITION BY {known}" if known else ""
        above = f"JOIN b{k - 1} p USING ({known})" if known else "CROSS JOIN total p"
        budget = "p.budget" if known else "p.total"
        sql += f""",
s{k} AS (SELECT {path}, CAST(sum(tokens) * {EPOCHS} AS DOUBLE) AS capacity FROM leaves GROUP BY ALL),
n{k} AS (SELECT {names}, capacity, coalesce(CAST(weight AS DOUBLE), 1.0) AS weight FROM s{k} s LEFT JOIN w ON {on}),
r{k} AS (SELECT n.*, {budget} AS parent, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM n{k} n {above}),
u{k} AS (
  SELECT *, coalesce(sum(capacity) OVER ({by} ORDER BY ratio, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({by} ORDER BY ratio, {path} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM r{k}
),
f{k} AS (SELECT *, (parent - used) / weights AS level, coalesce(ratio <= (parent - used) / weights, false) AS filled FROM u{k}),
b{k} AS (
  SELECT {path}, greatest(0.0, CASE WHEN filled THEN capacity ELSE weight * coalesce(first_value(CASE WHEN NOT filled THEN level END IGNORE NULLS)
    OVER ({by} ORDER BY filled, ratio, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) END) AS budget FROM f{k}
)"""
    path = ", ".join(LEVELS)
    return sql + f""",
plan AS (
  SELECT {path}, tokens, CAST(least(floor(budget + 1e-6), tokens * {EPOCHS}) AS BIGINT) AS budget FROM leaves JOIN b2 USING ({path})
),
parts AS (
  SELECT {path}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM plan
),
keyed AS (SELECT *, md5(concat('{SEED}|', whole, '|', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM d JOIN parts USING ({path})),
placed AS (SELECT *, sum(n) OVER (PARTITION BY {path} ORDER BY key) - sum(n) OVER (PARTITION BY {path}, key) AS before FROM keyed),
taken AS (
  SELECT doc_id, lang0, source0, e.epoch, n AS t FROM keyed, LATERAL (SELECT unnest(range(whole)) AS epoch) e
  UNION ALL
  SELECT doc_id, lang0, source0, whole, least(n, rest - before) FROM placed WHERE rest > 0 AND before < rest
)
SELECT doc_id, lang0 AS lang, source0 AS source, CAST(epoch AS INTEGER) AS epoch, CAST(t AS BIGINT) AS taken_tokens FROM taken
"""


OP9_SQL = _sql()
