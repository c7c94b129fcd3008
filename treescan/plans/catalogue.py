"""Queries over the namespace views, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import modes, template, text
from ..operators import control as ctl
from ..operators import counters, dedup, devices, history, ranking, traverse
from ..schema import KEY
from ..sources import namespace as ns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a function under its name, with SQL that may use the namespace views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {ns.SQL}\n{sql}" if views else sql
        return f

    return add


# --- traversal and sets -------------------------------------------------------------------------


@query("SELECT path, is_dir, dev, ino, size, level + 1 AS depth FROM entries")
def full_scan_listing(spark, d):
    """All below the root, level by level."""
    return traverse.walk(ns.entries(spark, d), "").select("path", "is_dir", "dev", "ino", "size", "depth")


@query("SELECT path, level + 1 AS depth FROM entries WHERE is_dir")
def recursive_tree_depths(spark, d):
    """Directories only, by levels of paths."""
    return traverse.depths(ns.directories(spark, d).select("path", "parent"), "")


@query("SELECT path, dev, ino, size, mtime FROM files0 WHERE nth = 1")
def dedup_first_wins(spark, d):
    """J1 U2 F4 W9."""
    raw = ns.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    first = dedup.first_wins(raw, ["l_shipdate", "l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    kept = ns.files(spark, d).select("path", "dev", "ino", "size", "mtime")
    ino = F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100_000_000
    return kept.join(first.select(ino.alias("ino")), "ino", "left_semi").select("path", "dev", "ino", "size", "mtime")


@query("SELECT path, dev, ino, mtime FROM entries e WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.path = e.path AND h.dev = e.dev AND h.ino = e.ino)")
def visited_anti_join(spark, d):
    """What history hasn't seen."""
    return dedup.unseen(ns.entries(spark, d), ns.history(spark, d)).select(*KEY, "mtime")


@query("SELECT path, dev, ino, size FROM entries e WHERE EXISTS (SELECT 1 FROM history h WHERE h.path = e.path AND h.dev = e.dev AND h.ino = e.ino)")
def trust_candidates(spark, d):
    """U4 J2."""
    return dedup.seen_before(ns.entries(spark, d), ns.history(spark, d)).select(*KEY, "size")


_MARKED = f"""SELECT e.*, h.mtime AS known_mtime, h.d_type AS known_type,
  coalesce(e.d_type <> 0 AND e.ino <> 0 AND e.d_type = h.d_type AND {ns.AS_OF} - h.mtime > {1826 * history.DAY}, false) AS trusted
  FROM typed e LEFT JOIN history h ON h.path = e.path AND h.dev = e.dev AND h.ino = e.ino"""


@query(f"""SELECT path, dev, ino, CAST(CASE WHEN trusted THEN 0 ELSE size END AS BIGINT) AS size, CASE WHEN trusted THEN known_mtime ELSE mtime END AS mtime,
  CAST(CASE WHEN NOT trusted THEN mode WHEN known_type = 8 THEN 32768 WHEN known_type = 4 THEN 16384 ELSE 40960 END AS INTEGER) AS mode,
  CASE WHEN trusted THEN 'history' ELSE 'stat' END AS stat_src FROM ({_MARKED})""")
def trust_split(spark, d):
    """The flagship. Entries older than five years in history keep what it knows."""
    rows = history.trusted_rows(ns.entries(spark, d), ns.history(spark, d), ns.AS_OF, 1826 * history.DAY)
    return rows.select(*KEY, "size", "mtime", "mode", "stat_src")


@query(f"SELECT trusted, CAST(count_if(is_dir) AS BIGINT) AS dir_count, CAST(count_if(NOT is_dir) AS BIGINT) AS file_count FROM ({_MARKED}) GROUP BY trusted")
def trust_savings_counts(spark, d):
    """F13 A1."""
    rows = history.marked(ns.entries(spark, d), ns.history(spark, d), ns.AS_OF, 1826 * history.DAY)
    return rows.groupBy("trusted").agg(F.count_if("is_dir").alias("dir_count"), F.count_if(~F.col("is_dir")).alias("file_count"))


@query("""SELECT path, dev, ino, mtime, CASE mode & 61440 WHEN 32768 THEN 8 WHEN 40960 THEN 10 END AS d_type FROM
  (SELECT *, row_number() OVER (PARTITION BY path, dev, ino ORDER BY mtime DESC, size DESC, uid DESC, mode DESC) AS k FROM files0) WHERE k = 1""")
def history_last_write_wins(spark, d):
    """Of repeated rows the last counts."""
    rows = ns.files(spark, d, repeats=True).withColumn("d_type", modes.d_type(F.col("mode")))
    last = dedup.last_wins(rows.select(*KEY, "mtime", "size", "uid", "mode", "d_type"), ["mtime", "size", "uid", "mode"])
    return last.select(*KEY, "mtime", "d_type")


@query("SELECT path, name, CAST(octet_length(encode(path)) AS INTEGER) AS bytes FROM (SELECT '/docs/' || replace(coalesce(text, ''), '/', ' ') AS path, replace(coalesce(text, ''), '/', ' ') AS name FROM documents) WHERE name NOT IN ('.', '..') AND octet_length(encode(path)) < 4096", views=False)
def path_length_filter(spark, d):
    """F1 F2: whole texts as names; paths of 4096 bytes or more go."""
    name = F.replace(F.coalesce("text", F.lit("")), F.lit("/"), F.lit(" "))
    rows = ns.table(spark, d, "documents").select(F.concat(F.lit("/docs/"), name).alias("path"), name.alias("name"))
    return dedup.within_limits(rows).withColumn("bytes", F.octet_length("path"))


@query("SELECT path, is_dir FROM entries WHERE NOT is_dir OR level < 2")
def include_dirs_toggle(spark, d):
    """files alone, and directories where they are asked for (here those of the two highest levels)."""
    e = ns.entries(spark, d)
    return dedup.emitted(e, False).unionByName(dedup.emitted(e.where("is_dir and level < 2"), True)).select("path", "is_dir")


@query("SELECT '目录: ' || path AS value FROM entries WHERE is_dir")
def dir_side_stream(spark, d):
    """K7: the lines of the directory log."""
    return ns.directories(spark, d).select(F.concat(F.lit("目录: "), "path").alias("value"))


@query("SELECT path, is_dir, size FROM entries WHERE path = (SELECT min(path) FROM entries WHERE NOT is_dir)")
def single_file_target(spark, d):
    """A target that is no directory is the only row."""
    f = ns.files(spark, d)
    return f.join(f.agg(F.min("path").alias("path")), "path").select("path", "is_dir", "size")


@query("""SELECT l.path, CAST(coalesce(t.mode, l.mode) AS INTEGER) AS mode, coalesce(t.size, l.size) AS size FROM
  (SELECT *, CASE WHEN ino % 2 = 0 THEN parent ELSE parent || '/none' END AS target FROM entries WHERE mode = 41471) l
  JOIN entries t ON t.path = l.target""")
def symlink_resolution(spark, d):
    """Links followed to their directory; those without a target go."""
    e = ns.entries(spark, d)
    target = F.when(F.col("ino") % 2 == 0, F.col("parent")).otherwise(F.concat("parent", F.lit("/none")))
    links = ns.files(spark, d).where(F.col("mode") == 0o120777).withColumn("target", target)
    return traverse.resolved(links, e, follow=True).select("path", "mode", "size")


# --- devices and control ------------------------------------------------------------------------

_FOLD = """fold0 AS (SELECT *, type <> 'ERROR' AS ok FROM control WHERE type IN ('ERROR', 'FINISH')),
fold1 AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY dev ORDER BY seq) AS run FROM fold0),
streak AS (SELECT dev, run, count(*) AS n FROM fold1 WHERE NOT ok GROUP BY dev, run),
worst AS (SELECT dev, max(n) AS worst FROM streak GROUP BY dev),
last AS (SELECT dev, arg_max(ok, seq) AS ok, max(run) AS run FROM fold1 GROUP BY dev),
device AS (SELECT dev, CASE WHEN coalesce(worst, 0) >= 9 THEN 'CONDEMNED' WHEN ok THEN 'NORMAL' ELSE 'DEAD' END AS state, CAST(coalesce(n, 0) AS BIGINT) AS failures
  FROM last LEFT JOIN streak USING (dev, run) LEFT JOIN worst USING (dev))"""
LIMIT = 9


def _with_devices(sql: str) -> str:
    return f"WITH {ns.SQL},\n{_FOLD}\n{sql}"


def _devices(spark, d) -> DataFrame:
    c = ns.control(spark, d)
    probes = c.where("type in ('ERROR', 'FINISH')")
    return devices.folded(probes.select("seq", "dev", (F.col("type") != "ERROR").alias("ok")), LIMIT)


@query(_with_devices("SELECT dev, state, failures FROM device"), views=False)
def device_state_fold(spark, d):
    """Devices after all their errors and successes."""
    return _devices(spark, d)


@query(_with_devices("SELECT state, CAST(count(*) AS BIGINT) AS devices FROM device GROUP BY state"), views=False)
def device_state_counts(spark, d):
    """A3."""
    return _devices(spark, d).groupBy("state").agg(F.count("*").alias("devices"))


@query(_with_devices("SELECT path, dev, size FROM entries WHERE dev NOT IN (SELECT dev FROM device WHERE state <> 'NORMAL')"), views=False)
def blacklist_filter(spark, d):
    """J5 F5."""
    return devices.reachable(ns.entries(spark, d), _devices(spark, d)).select("path", "dev", "size")


@query(_with_devices("SELECT coalesce(bool_or(coalesce(state, 'NORMAL') <> 'NORMAL'), false) AS has_error, CAST(count_if(coalesce(state, 'NORMAL') <> 'NORMAL') AS BIGINT) AS lost FROM entries LEFT JOIN device USING (dev)"), views=False)
def scan_has_error(spark, d):
    """Whether any entry was lost to a device."""
    rows = devices.with_state(ns.entries(spark, d), _devices(spark, d))
    bad = F.col("state") != "NORMAL"
    return rows.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_error"), F.count_if(bad).alias("lost"))


_SKIPPED = "skipped AS (SELECT seq, dev, '/dev' || dev || '/d' || seq AS path, CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS s_status, ts, CAST(value AS BIGINT) % 5 AS retry_count FROM control WHERE type = 'ERROR')"


def _skipped(spark, d) -> DataFrame:
    c = ns.control(spark, d).where("type = 'ERROR'")
    path = F.concat(F.lit("/dev"), F.col("dev").cast("string"), F.lit("/d"), F.col("seq").cast("string"))
    return c.select("seq", "dev", path.alias("path"), F.when(F.col("seq") % 11 == 0, 1).otherwise(0).alias("s_status"), "ts", "value")


@query(f"WITH {ns.SQL},\n{_SKIPPED} SELECT path, dev FROM skipped WHERE s_status <> 1 AND dev IN (2, 5)", views=False)
def skip_ledger_requeue(spark, d):
    """Directories of the devices that came back."""
    back = spark.createDataFrame([(2,), (5,)], "dev bigint")
    return devices.requeued(_skipped(spark, d), back).select("path", "dev")


@query(f"WITH {ns.SQL},\n{_SKIPPED} SELECT dev, arg_min(path, seq) AS probe_path FROM skipped GROUP BY dev", views=False)
def probe_first_path(spark, d):
    """J7."""
    return devices.first_skipped(_skipped(spark, d))


@query(f"WITH {ns.SQL},\n{_SKIPPED} SELECT path, dev, CASE s_status WHEN 1 THEN 'CONDEMNED' ELSE 'DEAD' END AS state, ts + 5 AS next_probe FROM skipped", views=False)
def skip_ledger_states(spark, d):
    """What reading the skip ledger makes of each row."""
    state = F.when(F.col("s_status") == 1, "CONDEMNED").otherwise("DEAD")
    return _skipped(spark, d).select("path", "dev", state.alias("state"), (F.col("ts") + 5).alias("next_probe"))


@query(f"WITH {ns.SQL},\n{_SKIPPED} SELECT seq, dev, next_probe FROM (SELECT seq, dev, ts + least(300, 5 * (1 << CAST(seq % 8 AS INTEGER))) AS next_probe FROM skipped) WHERE next_probe <= (SELECT max(ts) FROM skipped) ORDER BY next_probe, dev, seq LIMIT 20", views=False)
def probe_due_topk(spark, d):
    """The probes that are due, first ones first (a heap's feature is its top)."""
    s = _skipped(spark, d)
    due = s.select("seq", "dev", (F.col("ts") + text.backoff(F.col("seq") % 8)).alias("next_probe"))
    now = s.agg(F.max("ts").alias("now"))
    return due.join(F.broadcast(now), F.col("next_probe") <= F.col("now")).drop("now").orderBy("next_probe", "dev", "seq").limit(20)  # one row is broadcast


@query("SELECT CAST(k AS BIGINT) AS failures, CAST(least(300, 5 * (1 << CAST(k AS INTEGER))) AS BIGINT) AS seconds FROM range(12) t(k)", views=False)
def probe_backoff_schedule(spark, d):
    """X22 T7."""
    return spark.range(12).select(F.col("id").alias("failures"), text.backoff(F.col("id")).alias("seconds"))


@query("SELECT worker, seq, type, CASE WHEN type = 'ERROR' THEN 'DEAD' WHEN type IN ('READY', 'FINISH') THEN 'IDLE' ELSE 'BUSY' END AS state FROM (SELECT worker, max(seq) AS seq, arg_max(type, seq) AS type FROM control GROUP BY worker)")
def worker_state_latest(spark, d):
    """T3 W9."""
    return ctl.latest_state(ns.control(spark, d))


GAP = 2 * 3600


@query(f"SELECT worker, seq, gap FROM (SELECT worker, seq, ts - lag(ts) OVER (PARTITION BY worker ORDER BY ts, seq) AS gap FROM control) WHERE gap > {GAP}")
def heartbeat_gaps(spark, d):
    """Silences longer than two hours."""
    return ctl.gaps(ns.control(spark, d), GAP).select("worker", "seq", "gap")


@query(f"""SELECT worker, last, silence, silence > CASE WHEN last = born THEN {2 * GAP} ELSE {GAP} END AS timed_out FROM
  (SELECT worker, max(ts) AS last, max(CASE WHEN type = 'READY' THEN ts END) AS born, (SELECT max(ts) FROM control) + {GAP // 2} - max(ts) AS silence FROM control GROUP BY worker)""")
def worker_timeouts(spark, d):
    """an hour after the last message, who has been silent for two hours or, since it was ready, for four."""
    events = ns.control(spark, d)
    now = events.agg((F.max("ts") + GAP // 2).alias("now")).scalar()
    return ctl.timeouts(events, now, GAP, 2 * GAP)


@query(f"""SELECT worker, CAST(min(ts) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS events FROM
  (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts, seq) AS s FROM
    (SELECT *, ts - lag(ts) OVER (PARTITION BY worker ORDER BY ts, seq) AS gap FROM control)) GROUP BY worker, s""")
def heartbeat_sessions(spark, d):
    """T4."""
    return ctl.sessions(ns.control(spark, d), GAP)


@query("SELECT worker, CAST(count_if(type = 'BATCH') - count_if(type = 'FINISH') AS BIGINT) AS orphans FROM control GROUP BY worker")
def orphaned_tasks(spark, d):
    """A11 T9."""
    kinds = F.count_if(F.col("type") == "BATCH") - F.count_if(F.col("type") == "FINISH")
    return ns.control(spark, d).groupBy("worker").agg(kinds.alias("orphans"))


@query("SELECT worker, seq, CAST(sum(CASE type WHEN 'BATCH' THEN 1 WHEN 'FINISH' THEN -1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY seq) AS BIGINT) AS open FROM control")
def outstanding_running(spark, d):
    """A12."""
    rows = ctl.outstanding(ns.control(spark, d), F.col("type") == "BATCH", F.col("type") == "FINISH")
    return rows.select("worker", "seq", "open")


@query("SELECT seq, dev, CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS place FROM control WHERE type = 'ERROR'")
def retry_queue_order(spark, d):
    """Lost tasks, first in first out."""
    return ranking.numbered(ns.control(spark, d).where("type = 'ERROR'").select("seq", "dev"), "seq", name="place")


@query("SELECT DISTINCT ON (worker, dev) worker, dev, seq FROM control WHERE type = 'ERROR' ORDER BY worker, dev, seq")
def stale_dead_ignored(spark, d):
    """of the reports of one worker's loss of one device the first counts."""
    return dedup.first_wins(ns.control(spark, d).where("type = 'ERROR'").select("worker", "dev", "seq"), ["seq"], ["worker", "dev"]).select("worker", "dev", "seq")


@query("SELECT path, CASE WHEN e.dev % 2 = 0 THEN '[unsupported]   ' ELSE '----------------' END AS xattr FROM entries e")
def device_capability(spark, d):
    """Flags are asked for only on devices that have them."""
    capable = spark.createDataFrame([(k, k % 2 == 1) for k in range(1, 5)], "dev bigint, capable boolean")
    rows = ns.entries(spark, d).join(capable, "dev", "left")
    flags = F.when(F.coalesce("capable", F.lit(True)), modes.flag_string(F.lit(0))).otherwise(template.NO_FLAGS)
    return rows.select("path", flags.alias("xattr"))


@query("""SELECT worker, seq FROM (SELECT worker, max(seq) AS seq, arg_max(type, seq) AS type FROM control GROUP BY worker)
  WHERE type IN ('READY', 'FINISH') ORDER BY (worker - 3 + 8) % 8 LIMIT 1""")
def idle_worker_pick(spark, d):
    """The first idle worker from the third on, round the ring (one pick is the feature)."""
    idle = ctl.latest_state(ns.control(spark, d)).where("state = 'IDLE'")
    return idle.orderBy((F.col("worker") - 3 + 8) % 8).limit(1).select("worker", "seq")


@query(f"""WITH {ns.SQL},
{_FOLD},
{_SKIPPED},
hourly AS (SELECT ts, sum(n) OVER (ORDER BY ts) AS total FROM (SELECT ts // 3600 * 3600 AS ts, count(*) AS n FROM control GROUP BY 1)),
rate AS (SELECT ts, CASE WHEN ts > t0 THEN (total - c0) / (ts - t0) ELSE 0.0 END AS rate FROM
  (SELECT *, first_value(ts) OVER w AS t0, first_value(total) OVER w AS c0 FROM hourly WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))),
w AS (SELECT worker, CASE arg_max(type, seq) WHEN 'ERROR' THEN 'DEAD' WHEN 'READY' THEN 'IDLE' WHEN 'FINISH' THEN 'IDLE' ELSE 'BUSY' END AS state,
  count_if(type = 'BATCH') - count_if(type = 'FINISH') AS open FROM control GROUP BY worker),
probe AS (SELECT dev, regexp_replace(arg_min(path, seq), '([^/]+)([^/])', '***\\2', 'g') AS path FROM skipped GROUP BY dev),
c AS (SELECT count_if(is_dir) AS dirs, count_if(NOT is_dir) AS files, max(mtime) - min(mtime) AS age FROM entries),
v AS (SELECT count_if(state = 'DEAD') AS dead, count_if(state = 'CONDEMNED') AS condemned FROM device)
SELECT 'directories ' || dirs || ', files ' || files AS value FROM c
UNION ALL SELECT 'devices dead ' || dead || ', condemned ' || condemned FROM v
UNION ALL SELECT 'elapsed ' || (age // 86400) || 'd ' || lpad(CAST(age % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(age % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(age % 60 AS VARCHAR), 2, '0') FROM c
UNION ALL SELECT 'workers ' || count_if(state <> 'DEAD') || ' of ' || count(*) || ', tasks pending ' || sum(open) FROM w
UNION ALL SELECT 'worker ' || worker || ' ' || state || ' -' FROM w
UNION ALL SELECT 'rate ' || CAST(round(arg_max(rate, ts) * 3600) AS BIGINT) || ' an hour, most ' || CAST(round(max(rate) * 3600) AS BIGINT) FROM rate
UNION ALL SELECT 'probe of device ' || dev || ' ' || CASE WHEN length(path) > 20 THEN '...' || right(path, 20) ELSE path END FROM probe""", views=False)
def monitor_panel(spark, d):
    """The lines of the progress panel."""
    e = ns.entries(spark, d).agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), (F.max("mtime") - F.min("mtime")).alias("age"))
    v = _devices(spark, d).agg(F.count_if(F.col("state") == "DEAD").alias("dead"), F.count_if(F.col("state") == "CONDEMNED").alias("condemned"))
    w = worker_state_latest(spark, d).join(orphaned_tasks(spark, d).withColumnRenamed("orphans", "open"), "worker")
    w = w.select("worker", "state", F.lit(None).cast("string").alias("path"), "open")
    at = (F.floor(F.col("ts") / 3600) * 3600).alias("ts")
    n = ns.control(spark, d).groupBy(at).agg(F.count("*").alias("n"))
    r = counters.rates(n.select("ts", F.sum("n").over(Window.orderBy("ts")).alias("total")))  # an hour a row
    r = r.agg((F.max_by("rate", "ts") * 3600).alias("rate"), (F.max("rate") * 3600).alias("peak_rate"))
    return counters.panel(e, v, w, r, probe_first_path(spark, d).withColumnRenamed("probe_path", "path"))


# --- formats ------------------------------------------------------------------------------------

_NAMED = "named AS (SELECT *, coalesce(user_name || '(' || uid || ')', CAST(uid AS VARCHAR)) AS u, coalesce(group_name || '(' || gid || ')', CAST(gid AS VARCHAR)) AS g FROM entries LEFT JOIN users USING (uid) LEFT JOIN groups USING (gid))"
_CLOCK = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')"
_MODE = "CASE mode WHEN 16877 THEN 'drwxr-xr-x' WHEN 33188 THEN '-rw-r--r--' WHEN 35309 THEN '-rwsr-xr-x' WHEN 41471 THEN 'lrwxrwxrwx' END"
_TYPE = "CASE mode & 61440 WHEN 16384 THEN 'DIR' WHEN 32768 THEN 'FILE' WHEN 40960 THEN 'LINK' END"
_OCTAL = "'0' || to_base(mode & 511, 8)"


def _lines(df: DataFrame, spark, d, form: str, **how) -> DataFrame:
    if template.letters_of(form) & {"u", "g"}:
        df = ns.owners(df, spark, d)
    if "X" in template.letters_of(form):
        df = df.withColumn("xattr", F.lit(template.NO_FLAGS))
    return df.select(template.compiled(form, **how).alias("value"))


@query(f"SELECT path || '|' || size || '|' || {_CLOCK.format('mtime')} AS value FROM entries")
def fmt_default_text(spark, d):
    """Path, size, mtime."""
    return _lines(ns.entries(spark, d), spark, d, template.from_switches())


@query(f"WITH {ns.SQL},\n{_NAMED} SELECT path || '|' || size || '|' || u || '|' || {_CLOCK.format('mtime')} || '|' || {_MODE} || '|[unsupported]   ' AS value FROM named", views=False)
def fmt_switches(spark, d):
    """P16 P14."""
    return _lines(ns.entries(spark, d), spark, d, template.from_switches(size=True, user=True, mtime=True, mode=True, xattr=True))


def _csv(*parts: str) -> str:
    return " || ',' || ".join(f"""'"' || replace({x}, '"', '""') || '"'""" for x in parts)


_TWELVE = ("CAST(ino AS VARCHAR)", "path", "CAST(size AS VARCHAR)", "u", "g", "CAST(uid AS VARCHAR)", "CAST(gid AS VARCHAR)", _MODE, _OCTAL, _TYPE, _CLOCK.format("mtime"), _CLOCK.format("ctime"))


@query(f"WITH {ns.SQL},\n{_NAMED} SELECT {_csv(*_TWELVE)} AS value FROM named", views=False)
def fmt_csv_default(spark, d):
    """P17 K2 X6."""
    return _lines(ns.entries(spark, d), spark, d, template.CSV, csv=True)


@query(f"""SELECT {_csv("coalesce(text, '')", 'CAST(n_chars AS VARCHAR)')} AS value FROM documents""", views=False)
def fmt_csv_texts(spark, d):
    """K2 X6 on texts with quotes and line ends."""
    docs = ns.table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("path"), F.col("n_chars").alias("size"))
    return docs.select(template.compiled("%p,%s", csv=True).alias("value"))


@query("""SELECT '"' || path || '" "' || size || '"' AS value FROM entries""")
def fmt_quote_mode(spark, d):
    """K3 X7."""
    return _lines(ns.entries(spark, d), spark, d, "%p %s", quote=True)


@query(f"""WITH {ns.SQL},\n{_NAMED} SELECT '[%%' || {_TYPE} || '] ' || path || '\\t' || uid || ':' || gid || ' ' || g || ' ' || {_OCTAL} || ' ' || ino || ' %z ' || {_CLOCK.format('atime')} || ' ' || {_CLOCK.format('ctime')} AS value FROM named""", views=False)
def fmt_custom_template(spark, d):
    """Literals, an unknown letter, doubled and lone percent signs, an undecoded backslash."""
    return _lines(ns.entries(spark, d), spark, d, "[%%%t] %p\\t%U:%G %g %O %i %z %a %c%")


@query(f"SELECT path, {_MODE} AS mode_string FROM entries")
def mode_string(spark, d):
    """X2 P12."""
    return ns.entries(spark, d).select("path", modes.mode_string(F.col("mode")).alias("mode_string"))


@query(f"SELECT path, {_OCTAL} AS octal FROM entries")
def mode_octal(spark, d):
    """X3 P13."""
    return ns.entries(spark, d).select("path", modes.mode_octal(F.col("mode")).alias("octal"))


@query(f"SELECT path, {_TYPE} AS label, d_type FROM typed")
def type_label(spark, d):
    """X1 X13 P10."""
    m = F.col("mode")
    return ns.entries(spark, d).select("path", modes.type_label(m).alias("label"), modes.d_type(m).alias("d_type"))


@query(f"WITH {ns.SQL},\n{_NAMED} SELECT path, u AS user_label, g AS group_label FROM named", views=False)
def owner_labels(spark, d):
    """J4 X5 P3 P4 S15."""
    rows = ns.owners(ns.entries(spark, d), spark, d)
    return rows.select("path", text.owner(F.col("user_name"), F.col("uid")).alias("user_label"), text.owner(F.col("group_name"), F.col("gid")).alias("group_label"))


_PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '')"


@query(f"SELECT page_id, regexp_replace({_PAGE}, '([^/]+)([^/])', '***\\2', 'g') AS masked, CASE WHEN length({_PAGE}) > 20 THEN '...' || right({_PAGE}, 20) ELSE {_PAGE} END AS short FROM pages", views=False)
def path_mask(spark, d):
    """X8 X20 on the paths of urls."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    return ns.table(spark, d, "pages").select("page_id", text.masked(path).alias("masked"), text.shortened(path).alias("short"))


@query("SELECT path, md5(path || '|' || dev || '|' || ino) AS fingerprint, CAST(('0x' || substr(md5(path || '|' || dev || '|' || ino), 1, 2))::INTEGER >> 2 AS INTEGER) AS shard FROM entries")
def fingerprint_md5(spark, d):
    """X9 X11."""
    digest = text.fingerprint(F.col("path"), F.col("dev"), F.col("ino"))
    return ns.entries(spark, d).select("path", digest.alias("fingerprint")).withColumn("shard", text.shard(F.col("fingerprint")))


@query("SELECT CAST(shard AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS entries, CAST(power(2, ceil(log2(count(*)))) AS BIGINT) AS capacity FROM (SELECT ino % 64 AS shard FROM entries) GROUP BY shard")
def shard_sizes(spark, d):
    """How many entries a shard has, and the power of two that holds them."""
    rows = ns.entries(spark, d).groupBy((F.col("ino") % 64).cast("int").alias("shard")).agg(F.count("*").alias("entries"))
    return rows.withColumn("capacity", F.pow(F.lit(2), F.ceil(F.log2("entries"))).cast("bigint"))


@query("SELECT p_partkey, " + " || ".join(f"CASE WHEN (CAST(p_size AS INTEGER) * 1311) & {1 << k} <> 0 THEN '{x}' ELSE '-' END" for k, x in enumerate(modes.FLAGS)) + " AS flags FROM part", views=False)
def lsattr_flags(spark, d):
    """X16 S16 P14."""
    return ns.table(spark, d, "part").select("p_partkey", modes.flag_string(F.col("p_size") * 1311).alias("flags"))


@query("SELECT CAST(k AS BIGINT) AS seconds, (k // 86400) || 'd ' || lpad(CAST(k % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') AS elapsed FROM (SELECT DISTINCT CAST(epoch(date_trunc('second', ts)) AS BIGINT) - (SELECT min(CAST(epoch(date_trunc('second', ts)) AS BIGINT)) FROM events) AS k FROM events)", views=False)
def elapsed_format(spark, d):
    """X14."""
    e = ns.table(spark, d, "events").select(ns.seconds("ts").alias("t"))
    rows = e.join(F.broadcast(e.agg(F.min("t").alias("t0")))).select((F.col("t") - F.col("t0")).alias("seconds")).distinct()  # one row is broadcast
    return rows.withColumn("elapsed", text.elapsed(F.col("seconds")))


@query("SELECT CAST(k AS BIGINT) AS k, 'scan.idx' AS index_name, 'scan_' || lpad(CAST(k AS VARCHAR), 6, '0') || '.pbin' AS slice_name, 'scan_' || lpad(CAST(k AS VARCHAR), 6, '0') || '.fpbin' AS frontier_name, 'scan.archive' AS archive_name FROM range(120) t(k)", views=False)
def file_names(spark, d):
    """X19."""
    base, k = F.lit("scan"), F.col("id")
    names = {f"{x}_name": text.file_name(x, base, k) for x in ("index", "slice", "frontier", "archive")}
    return spark.range(120).select(k.alias("k"), *[v.alias(n) for n, v in names.items()])


_LINES = ["path=/data", "status=Running", "status=Success", "output=a=b", "archive=false", "note", "start_time=2001-12-01 00:00:00"]


@query("SELECT split_part(l, '=', 1) AS key, CASE WHEN contains(l, '=') THEN substr(l, strpos(l, '=') + 1) END AS value FROM (VALUES " + ", ".join(f"('{x}')" for x in _LINES) + ") t(l)", views=False)
def session_config_parse(spark, d):
    """S12 X21."""
    rows = spark.createDataFrame([(x,) for x in _LINES], "line string")
    key, value = text.setting(F.col("line"))
    return rows.select(key.alias("key"), value.alias("value"))


@query("SELECT bool_or(l IN ('status=Running', 'status=Success')) AS may_continue, bool_or(l = 'status=Success') AS succeeded, bool_or(l = 'path=/data') AS same_path FROM (VALUES " + ", ".join(f"('{x}')" for x in _LINES) + ") t(l)", views=False)
def session_resume_check(spark, d):
    """A10 F12."""
    k, v = F.col("key"), F.col("value")
    return session_config_parse(spark, d).agg(
        F.bool_or((k == "status") & v.isin("Running", "Success")).alias("may_continue"),
        F.bool_or((k == "status") & (v == "Success")).alias("succeeded"),
        F.bool_or((k == "path") & (v == "/data")).alias("same_path"),
    )


# --- slices, ledgers, resume --------------------------------------------------------------------

SLICE = 10_000


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rn, CAST((row_number() OVER (ORDER BY path) - 1) // {SLICE} + 1 AS BIGINT) AS slice FROM entries")
def output_slices(spark, d):
    """Rows of sliced output, slices from 1."""
    rows = ranking.numbered(ns.entries(spark, d).select("path"), "path")
    return rows.select("path", "rn", (F.floor((F.col("rn") - 1) / SLICE) + 1).alias("slice"))


_LEDGER = f"ledger AS (SELECT path, dev, ino, mtime, d_type, CAST((rn - 1) // {SLICE} AS BIGINT) AS slice, CAST((rn - 1) % {SLICE} AS BIGINT) AS line FROM (SELECT *, row_number() OVER (ORDER BY path) AS rn FROM typed))"


def _ledger(spark, d) -> DataFrame:
    rows = ns.entries(spark, d).select(*KEY, "mtime", modes.d_type(F.col("mode")).alias("d_type"))
    at = F.col("rn") - 1
    return ranking.numbered(rows, "path").select(*KEY, "mtime", "d_type", F.floor(at / SLICE).alias("slice"), (at % SLICE).alias("line"))


@query(f"WITH {ns.SQL},\n{_LEDGER} SELECT path, dev, ino, mtime, d_type, slice, line FROM ledger", views=False)
def ledger_slices(spark, d):
    """K8 P18 W5."""
    return _ledger(spark, d)


@query(f"WITH {ns.SQL},\n{_LEDGER} SELECT slice, CAST(count(*) AS BIGINT) AS lines, CAST(max(line) AS BIGINT) AS last_line FROM ledger GROUP BY slice", views=False)
def ledger_slice_counts(spark, d):
    """A4 A6 S14."""
    return _ledger(spark, d).groupBy("slice").agg(F.count("*").alias("lines"), F.max("line").alias("last_line"))


@query(f"WITH {ns.SQL},\n{_LEDGER} SELECT path, slice, line FROM ledger WHERE slice < 2 OR slice = 2 AND line < 1234", views=False)
def ledger_cutoff(spark, d):
    """Whole slices before the cursor's, its first lines, nothing after."""
    return _ledger(spark, d).where("slice < 2 or slice = 2 and line < 1234").select("path", "slice", "line")


@query(f"""WITH {ns.SQL},\n{_LEDGER} SELECT id FROM (SELECT id, max(CASE WHEN missing > 50 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS stopped FROM
  (SELECT id, id - coalesce(lag(id) OVER (ORDER BY id), -1) - 1 AS missing FROM (SELECT DISTINCT slice AS id FROM ledger))) WHERE stopped = 0""", views=False)
def slice_gap_stop(spark, d):
    """Slices up to the first gap of more than fifty ids."""
    ids = _ledger(spark, d).select(F.col("slice").alias("id")).distinct()
    return counters.slices_before_gap(ids)


@query("""SELECT path, dev, ino, mtime, CAST(max(block) AS INTEGER) AS block FROM (SELECT path, dev, ino, mtime, 1 AS block FROM history WHERE ino % 3 <> 0
  UNION ALL SELECT path, dev, ino, mtime, 2 FROM history WHERE ino % 3 <> 1) GROUP BY ALL""")
def history_union(spark, d):
    """Archive blocks and loose slices together, each key once."""
    h = ns.history(spark, d).select(*KEY, "mtime")
    both = h.where("ino % 3 <> 0").withColumn("block", F.lit(1)).unionByName(h.where("ino % 3 <> 1").withColumn("block", F.lit(2)))
    return both.groupBy(*KEY, "mtime").agg(F.max("block").alias("block"))


@query("SELECT CAST(CASE WHEN ino % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS block_type, CAST(count(*) AS BIGINT) AS rows FROM history GROUP BY 1")
def archive_blocks(spark, d):
    """A5."""
    kind = F.when(F.col("ino") % 3 == 0, 2).otherwise(1)
    return ns.history(spark, d).groupBy(kind.alias("block_type")).agg(F.count("*").alias("rows"))


@query("""SELECT e.path, e.is_dir, e.mtime FROM entries e WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.path = e.path AND h.dev = e.dev AND h.ino = e.ino)
  AND EXISTS (SELECT 1 FROM history h WHERE h.path = e.parent AND h.d_type = 4)""")
def resume_new_entries(spark, d):
    """Children of history's directories that history hasn't."""
    seen = ns.history(spark, d)
    parents = seen.where("d_type = 4").select(F.col("path").alias("parent"))
    fresh = dedup.unseen(ns.entries(spark, d).join(parents, "parent", "left_semi"), seen)
    return fresh.select("path", "is_dir", "mtime")


@query("SELECT path, dev, ino, 'ledger' AS phase FROM history WHERE d_type = 4 UNION ALL SELECT path, dev, ino, 'frontier' FROM typed t WHERE d_type = 4 AND mtime >= " + str(ns.HISTORY_BEFORE))
def frontier_promotion(spark, d):
    """The new directories join the ledger."""
    dirs = ns.directories(spark, d).select(*KEY, "mtime")
    old = ns.history(spark, d).where("d_type = 4").select(*KEY, F.lit("ledger").alias("phase"))
    fresh = dedup.unseen(dirs, old).select(*KEY, F.lit("frontier").alias("phase"))
    return old.unionByName(fresh)


@query("SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rn FROM history WHERE d_type = 4 ORDER BY path LIMIT 1024")
def pump_limit_dirs(spark, d):
    """O2 F8: a turn of the pump takes one batch of directories (the limit is the feature)."""
    turn = ns.history(spark, d).where("d_type = 4").select("path").orderBy("path").limit(1024)
    return turn.withColumn("rn", F.row_number().over(Window.orderBy("path")).cast("bigint"))  # over one batch


@query("SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) % 7 AS INTEGER) AS worker FROM entries WHERE is_dir")
def round_robin_dispatch(spark, d):
    """W8 O5 T16."""
    rows = ranking.numbered(ns.directories(spark, d).select("path"), "path")
    return rows.select("path", ((F.col("rn") - 1) % 7).cast("int").alias("worker"))


@query("SELECT CAST(count_if(is_dir) AS BIGINT) AS dir_count, CAST(count_if(NOT is_dir) AS BIGINT) AS file_count FROM entries")
def scan_counters(spark, d):
    """A1."""
    return counters.scan_counts(ns.entries(spark, d))


@query("SELECT CAST(sum(n // 4 + 1) AS BIGINT) AS batches FROM (SELECT parent, count(*) AS n FROM entries GROUP BY parent)")
def scan_batches(spark, d):
    """A2 T1."""
    return counters.batches(ns.entries(spark, d), 4)


@query("""SELECT ts, CAST(total AS BIGINT) AS total, round(rate, 9) AS rate, round(mean_rate, 9) AS mean_rate, round(max(rate) OVER (ORDER BY ts), 9) AS peak_rate FROM (
  SELECT ts, total, CASE WHEN ts > t0 THEN (total - c0) / (ts - t0) ELSE 0.0 END AS rate, CASE WHEN ts - tf >= 1 THEN (total - cf) / (ts - tf) ELSE 0.0 END AS mean_rate FROM (
    SELECT *, first_value(ts) OVER w AS t0, first_value(total) OVER w AS c0, first_value(ts) OVER (ORDER BY ts) AS tf, first_value(total) OVER (ORDER BY ts) AS cf FROM (
      SELECT ts, sum(n) OVER (ORDER BY ts) AS total FROM (SELECT ts // 3600 * 3600 AS ts, count(*) AS n FROM control GROUP BY 1))
    WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)))""")
def rate_window_60(spark, d):
    """Rates from hourly samples of the events."""
    hour = (F.floor(F.col("ts") / 3600) * 3600).alias("ts")
    n = ns.control(spark, d).groupBy(hour).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy("ts"))  # an hour a row
    out = counters.rates(n.select("ts", total.alias("total")))
    return out.select("ts", "total", *[F.round(c, 9).alias(c) for c in ("rate", "mean_rate", "peak_rate")])


# --- the real world -----------------------------------------------------------------------------


@query("SELECT path, left(path, 31) AS bounded FROM entries")
def bounded_paths(spark, d):
    """Paths cut to a field of 32 bytes with its end (names are ASCII here; the tests have others)."""
    return ns.entries(spark, d).select("path", text.bounded(F.col("path"), 32).alias("bounded"))


@query()
def fs_real_listing(spark, d):
    """A folder's own tree, through the file-system source (local paths)."""
    from ..sources.filesystem import scan

    return scan(spark, d.removeprefix("file://"))


@query()
def footer_crc(spark, d):
    """Footers of sealed slices: magic, rows, and a CRC-32 of the first sixteen bytes."""
    from ..sources.binary import footer, footer_ok

    rows = spark.createDataFrame([(bytearray(footer(n)),) for n in (0, 1, 100_000)] + [(bytearray(24),)], "content binary")
    return rows.select(F.hex("content").alias("content"), footer_ok(F.col("content")).alias("ok"))


@query("SELECT path, dev, ino, size, mtime FROM files0 WHERE nth = 1")
def stream_dedup(spark, d):
    """The lines as a stream, each key once."""
    from ..streaming.dedup import drained

    return drained(spark, d)


@query(f"""SELECT worker, CAST(min(ts) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS events FROM
  (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY ts, seq) AS s FROM
    (SELECT *, ts - lag(ts) OVER (PARTITION BY worker ORDER BY ts, seq) AS gap FROM control)) GROUP BY worker, s""")
def stream_heartbeats(spark, d):
    """T4 T5: sessions of a stream whose last events close all (each worker has one far in the future, left out here)."""
    from ..streaming.heartbeats import drained

    return drained(spark, d, GAP)


@query(_with_devices("SELECT dev, state, failures FROM device"), views=False)
def stream_device_fsm(spark, d):
    """The breaker as a stateful stream gives what the fold gives."""
    from ..streaming.breaker import drained

    return drained(spark, d, LIMIT)
