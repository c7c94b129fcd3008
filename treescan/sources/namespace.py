"""Trees made of tables: regions, nations, customers and orders are directories, order lines files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modes import d_type
from ..operators.dedup import first_wins
from ..schema import ENTRY, KEY

DIR_MODE = 0o040755
#: Constants of the views: modes of lines by return flag, the day of scans, and how far history goes.
FILE_MODES = {"N": 0o100644, "A": 0o104755, "R": 0o120777}
EPOCH_1995, AS_OF, HISTORY_BEFORE = 788_918_400, 1_007_164_800, 883_612_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {col})").cast("bigint")


def _entry(df: DataFrame, **cols) -> DataFrame:
    mtime = cols["mtime"]
    cols = {"atime": mtime + 86_400, "ctime": mtime, "path": F.concat_ws("/", cols["parent"], cols["name"]), **cols}
    fields = [x.split() for x in ENTRY.split(", ")]
    return df.select(*[(c if isinstance(c := cols[name], Column) else F.lit(c)).cast(kind).alias(name) for name, kind in fields])


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, nations and customers with their paths and devices."""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("dev"), "r_regionkey", F.col("r_name").alias("name"), F.concat(F.lit("/"), "r_name").alias("path"))
    n = table(spark, d, "nation").join(r.select("r_regionkey", "dev", F.col("path").alias("parent")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select("dev", "n_nationkey", F.col("n_name").alias("name"), "parent", F.concat_ws("/", "parent", "n_name").alias("path"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(n.select("n_nationkey", "dev", F.col("path").alias("parent")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("dev", "c_custkey", "c_nationkey", F.col("c_name").alias("name"), "parent", F.concat_ws("/", "parent", "c_name").alias("path"))
    return r, n, c


def _orders(spark: SparkSession, d: str, customers: DataFrame) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(customers.select("c_custkey", "c_nationkey", "dev", F.col("path").alias("parent")), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    return o.select("dev", "o_orderkey", "c_nationkey", seconds("o_orderdate").alias("mtime"), "parent", name.alias("name"), F.concat_ws("/", "parent", name).alias("path"))


def directories(spark: SparkSession, d: str) -> DataFrame:
    """The four levels of directories."""
    r, n, c = _places(spark, d)
    o = _orders(spark, d, c)
    fixed = {"is_dir": True, "size": 4096, "uid": 0, "gid": 0, "mode": DIR_MODE}
    levels = [
        _entry(r, parent=F.lit(""), name=F.col("name"), level=0, dev=F.col("dev"), ino=F.col("r_regionkey"), mtime=F.lit(EPOCH_1995), **fixed),
        _entry(n, parent=F.col("parent"), name=F.col("name"), level=1, dev=F.col("dev"), ino=F.col("n_nationkey") + 100, mtime=F.lit(EPOCH_1995), **fixed),
        _entry(c, parent=F.col("parent"), name=F.col("name"), level=2, dev=F.col("dev"), ino=F.col("c_custkey") + 1000, mtime=F.lit(EPOCH_1995), **fixed),
        _entry(o, parent=F.col("parent"), name=F.col("name"), level=3, dev=F.col("dev"), ino=F.col("o_orderkey") + 10_000_000, mtime=F.col("mtime"), **fixed),
    ]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def files(spark: SparkSession, d: str, repeats: bool = False) -> DataFrame:
    """Order lines as files: the first to arrive of each key or, with `repeats`, all."""
    lines = _lines(spark, d)
    if not repeats:  # before the join: the key settles the path
        lines = first_wins(lines, ["l_shipdate", "l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    o = _orders(spark, d, _places(spark, d)[2]).select("o_orderkey", "dev", "c_nationkey", F.col("path").alias("parent"))
    rows = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    mode = F.create_map(*[F.lit(x) for pair in FILE_MODES.items() for x in pair])[F.col("l_returnflag")]
    return _entry(
        rows, parent=F.col("parent"), name=F.concat(F.lit("f"), F.col("l_linenumber").cast("string")), is_dir=False, level=4, dev=F.col("dev"),
        ino=F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100_000_000, size=F.floor("l_extendedprice"), mtime=seconds("l_shipdate"),
        uid=F.col("l_suppkey"), gid=F.col("c_nationkey"), mode=mode,
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry once."""
    return directories(spark, d).unionByName(files(spark, d))


def history(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier scan saw: entries from before 1998."""
    old = entries(spark, d).where(F.col("mtime") < HISTORY_BEFORE)
    return old.select(*KEY, "mtime", d_type(F.col("mode")).alias("d_type"))


def owners(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """`df` with ``user_name, group_name``; ids without a name have null. The planner broadcasts names if they are few."""
    users = table(spark, d, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("user_name"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("gid"), F.col("n_name").alias("group_name"))
    return df.join(users, "uid", "left").join(groups, "gid", "left")


def control(spark: SparkSession, d: str) -> DataFrame:
    """Events as control messages of eight workers and five devices."""
    kinds = {"signup": "READY", "view": "BATCH", "purchase": "FINISH", "click": "HEARTBEAT", "error": "ERROR"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), seconds("ts").alias("ts"), (F.col("user_id") % 8).cast("int").alias("worker"),
        kind.alias("type"), (F.col("user_id") % 5 + 1).alias("dev"), F.col("value"),
    )


#: The same views for DuckDB.
SQL = f"""
p0 AS (SELECT r_regionkey, CAST(r_regionkey AS BIGINT) + 1 AS dev, r_name AS name, '/' || r_name AS path FROM region),
p1 AS (SELECT n_nationkey, p0.dev, n_name AS name, p0.path AS parent, p0.path || '/' || n_name AS path FROM nation JOIN p0 ON n_regionkey = r_regionkey),
p2 AS (SELECT c_custkey, c_nationkey, p1.dev, c_name AS name, p1.path AS parent, p1.path || '/' || c_name AS path FROM customer JOIN p1 ON c_nationkey = n_nationkey),
p3 AS (SELECT o_orderkey, c_nationkey, p2.dev, CAST(epoch(o_orderdate) AS BIGINT) AS mtime, p2.path AS parent, 'o' || o_orderkey AS name, p2.path || '/o' || o_orderkey AS path FROM orders JOIN p2 ON o_custkey = c_custkey),
dirs0 AS (
  SELECT path, '' AS parent, name, 0 AS level, dev, CAST(r_regionkey AS BIGINT) AS ino, {EPOCH_1995} AS mtime FROM p0
  UNION ALL SELECT path, parent, name, 1, dev, 100 + n_nationkey, {EPOCH_1995} FROM p1
  UNION ALL SELECT path, parent, name, 2, dev, 1000 + c_custkey, {EPOCH_1995} FROM p2
  UNION ALL SELECT path, parent, name, 3, dev, 10000000 + o_orderkey, mtime FROM p3
),
lines0 AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS nth FROM lineitem
),
files0 AS (
  SELECT parent || '/' || name AS path, parent, name, false AS is_dir, 4 AS level, dev, ino, size, mtime + 86400 AS atime, mtime, mtime AS ctime, uid, gid, mode, nth FROM (
    SELECT p3.path AS parent, 'f' || l_linenumber AS name, p3.dev, CAST(100000000 + l_orderkey * 8 + l_linenumber AS BIGINT) AS ino,
      CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(epoch(l_shipdate) AS BIGINT) AS mtime, l_suppkey AS uid, CAST(c_nationkey AS BIGINT) AS gid,
      CASE l_returnflag WHEN 'N' THEN {FILE_MODES["N"]} WHEN 'A' THEN {FILE_MODES["A"]} WHEN 'R' THEN {FILE_MODES["R"]} END AS mode, nth
    FROM lines0 JOIN p3 ON l_orderkey = o_orderkey)
),
entries AS MATERIALIZED (
  SELECT path, parent, name, true AS is_dir, level, dev, ino, CAST(4096 AS BIGINT) AS size, CAST(mtime AS BIGINT) + 86400 AS atime, CAST(mtime AS BIGINT) AS mtime,
    CAST(mtime AS BIGINT) AS ctime, CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid, {DIR_MODE} AS mode FROM dirs0
  UNION ALL SELECT * EXCLUDE (nth) FROM files0 WHERE nth = 1
),
typed AS (SELECT *, CASE mode & 61440 WHEN 32768 THEN 8 WHEN 16384 THEN 4 WHEN 40960 THEN 10 ELSE 0 END AS d_type FROM entries),
history AS MATERIALIZED (SELECT path, dev, ino, mtime, d_type FROM typed WHERE mtime < {HISTORY_BEFORE}),
users AS (SELECT s_suppkey AS uid, s_name AS user_name FROM supplier WHERE s_suppkey % 10 <> 0),
groups AS (SELECT CAST(n_nationkey AS BIGINT) AS gid, n_name AS group_name FROM nation),
control AS (
  SELECT event_id AS seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts, CAST(user_id % 8 AS INTEGER) AS worker,
    CASE event_type WHEN 'signup' THEN 'READY' WHEN 'view' THEN 'BATCH' WHEN 'purchase' THEN 'FINISH' WHEN 'click' THEN 'HEARTBEAT' WHEN 'error' THEN 'ERROR' END AS type,
    user_id % 5 + 1 AS dev, value FROM events
)"""
