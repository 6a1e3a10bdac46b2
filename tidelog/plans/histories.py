"""Queries over histories: commits of mixed kinds, messages with lag, keys that come and go, reports by incarnation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import scalars as S
from tidelog.operators import actors as A
from tidelog.operators import tasks as TK
from tidelog.operators import topics as TP
from tidelog.operators import versions as V
from tidelog.operators.folds import numbered
from tidelog.plans.queries import SEQ, query
from tidelog.sources.tables import TABLES, table

COMMITS = """(SELECT user_id, event_id, k AS version, CASE WHEN k = 1 OR event_id % 37 = 0 THEN 'Replace' WHEN event_id % 5 = 0 THEN 'Window' ELSE 'Append' END AS kind, event_id % 4 + 1 AS keep
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events))"""
STATES = f"""s AS (SELECT user_id, version, version AS low, version AS base, version AS root FROM {COMMITS} WHERE version = 1 UNION ALL
SELECT c.user_id, c.version, CASE kind WHEN 'Replace' THEN c.version WHEN 'Window' THEN greatest(low, c.version - keep) ELSE low END,
CASE WHEN kind = 'Replace' THEN c.version WHEN kind = 'Window' AND c.version - keep > low THEN greatest(base, c.version - keep - 1) ELSE base END, CASE WHEN kind = 'Append' THEN root ELSE c.version END
FROM s JOIN {COMMITS} c ON c.user_id = s.user_id AND c.version = s.version + 1)"""


def _commits(spark, sf):
    events = numbered(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "version")
    kind = F.when((F.col("version") == 1) | (F.col("event_id") % 37 == 0), "Replace").when(F.col("event_id") % 5 == 0, "Window").otherwise("Append")
    return events.select("user_id", "event_id", "version", kind.alias("kind"), (F.col("event_id") % 4 + 1).alias("keep"))


@query(f"WITH RECURSIVE {STATES} SELECT user_id, version, low, base, root FROM s")
def commit_kinds(spark, sf):
    """What a key holds after each commit, where readers lose rows, and where it began anew."""
    return V.commit_states(_commits(spark, sf), ["user_id"]).select("user_id", "version", "low", "base", "root")


@query(
    f"""WITH RECURSIVE {STATES}, h AS (SELECT user_id, max(version) AS head FROM s GROUP BY 1), r AS (SELECT DISTINCT user_id, head, greatest(0, head - unnest([head, 6, 3, 1, 0, -2])) AS since FROM h),
f AS (SELECT r.*, since > 0 AND since < base AND since < r.head AS truncated, low, root FROM r JOIN s ON s.user_id = r.user_id AND s.version = r.head),
x AS (SELECT *, CASE WHEN since >= head THEN head + 1 WHEN since = 0 OR truncated THEN low ELSE greatest(since + 1, low) END AS first, CASE WHEN since >= head THEN head WHEN since < root THEN root ELSE since + 1 END AS from_version FROM f)
SELECT x.user_id, x.since, c.event_id, c.version, x.from_version, x.truncated FROM x LEFT JOIN {COMMITS} c ON c.user_id = x.user_id AND c.version >= x.first AND c.version <= x.head"""
)
def delta_mixed(spark, sf):
    """The rows of deltas by key over commits of all kinds; a reader who gets none has one row without an event."""
    commits = _commits(spark, sf)
    heads = commits.groupBy("user_id").agg(F.max("version").alias("head"))
    back = F.explode(F.array(F.col("head"), *(F.lit(n).cast("long") for n in (6, 3, 1, 0, -2))))
    readers = heads.select("user_id", "head", back.alias("_back")).select("user_id", "head", F.greatest(F.col("head") - F.col("_back"), F.lit(0)).alias("since")).distinct()
    reads = V.mixed_reads(V.commit_states(commits, ["user_id"]), readers, ["user_id"])
    rows = commits.select(F.col("user_id").alias("_user"), "event_id", "version")
    held = (F.col("user_id") == F.col("_user")) & (F.col("version") >= F.col("first")) & (F.col("version") <= F.col("head"))
    return reads.join(rows, held, "left").select("user_id", "since", "event_id", "version", "from_version", "truncated")


READERS = [("new", 0), ("old", 20), ("near", 60), ("past", 5_000_000)]


@query(
    f"""WITH k AS (SELECT event_type, seq, event_id FROM {SEQ} WHERE seq > 50), r AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {c})" for n, c in READERS)}) v(reader, cursor)),
e AS (SELECT event_type, min(seq) AS first FROM k GROUP BY 1), f AS (SELECT event_type, reader, cursor, greatest(cursor, first - 1) AS from_seq FROM e, r)
SELECT f.event_type, reader, seq, event_id, 0::BIGINT AS lost FROM f JOIN k ON k.event_type = f.event_type AND seq > from_seq UNION ALL SELECT event_type, reader, cursor::BIGINT, NULL, (from_seq - cursor)::BIGINT FROM f WHERE from_seq > cursor"""
)
def topic_messages(spark, sf):
    """The messages that readers get of what a topic still holds, and a row for what each has lost."""
    kept = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id").where("seq > 50")
    asked = spark.createDataFrame(READERS, "reader string, cursor long")
    readers = kept.select("event_type").distinct().crossJoin(F.broadcast(asked))  # a literal
    return TP.read_messages(kept, readers, "event_type").select("event_type", "reader", "seq", "event_id", "lost")


@query(
    f"""WITH e AS (SELECT event_type, min(seq) FILTER (WHERE seq > 50) AS first, max(seq) AS head FROM {SEQ} GROUP BY 1), c AS (SELECT unnest([0, 20, 60]) AS cursor)
SELECT event_type, cursor::BIGINT AS cursor, 'event: lagged' || chr(10) || 'data: {{"resume":' || (first - 1) || ',"head":' || head || '}}' || chr(10) || chr(10) AS frame FROM e, c WHERE first > cursor + 1"""
)
def topic_lag_frames(spark, sf):
    kept = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id").where("seq > 50")
    asked = kept.select("event_type").distinct().withColumn("cursor", F.explode(F.lit([0, 20, 60]).cast("array<long>")))
    reads = TP.read_since(kept, asked, "event_type").where("truncated")
    heads = kept.groupBy("event_type").agg(F.max("seq").alias("head"))
    return reads.join(heads, "event_type").select("event_type", "cursor", TP.lag_frame(F.col("from_seq"), F.col("head")).alias("frame"))


@query(
    f"""WITH d AS (SELECT event_type, seq FROM {SEQ} WHERE event_id % 13 != 5 UNION ALL SELECT event_type, seq FROM {SEQ} WHERE event_id % 7 = 0)
SELECT event_type, count(*) AS got, count(*) - count(DISTINCT seq) AS repeats, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing FROM d GROUP BY 1"""
)
def topic_redelivered(spark, sf):
    """Every seventh message comes again and some never do."""
    m = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id")
    return TP.redelivered(m.where("event_id % 13 != 5").unionByName(m.where("event_id % 7 = 0")), ["event_type"])


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 4 = 0 AS ends, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 5) // 6 AS names, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, CASE WHEN ends THEN 'gone' ELSE 'created' END AS status, (NOT ends)::BIGINT AS generation, (NOT ends)::BIGINT AS version FROM o WHERE k = 1 UNION ALL
SELECT o.user_id, o.event_id, o.k, CASE WHEN ends AND version = 0 THEN 'gone' WHEN ends AND names = generation THEN 'deleted' WHEN ends THEN 'stale' WHEN version = 0 THEN 'created' ELSE 'installed' END,
CASE WHEN NOT ends AND version = 0 THEN generation + 1 ELSE generation END, CASE WHEN ends AND version > 0 AND names = generation THEN 0 WHEN ends THEN version ELSE version + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, status, generation, version FROM w"""
)
def key_lifecycle(spark, sf):
    """Puts and deletions of keys: a deletion names the generation that it means, and a put after one begins the next generation at version 1."""
    ops = numbered(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "k")
    named = ops.select("user_id", "event_id", (F.col("event_id") % 4 == 0).alias("ends"), F.floor((F.col("k") + 5) / 6).alias("names"))
    return V.lifecycles(named, "user_id", "event_id", "ends", "names")


@query(
    """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_reply NULLS LAST, incarnation) AS place FROM (SELECT user_id, event_id // 2000 AS incarnation, count(*) AS asks, count(*) FILTER (WHERE event_type = 'purchase') AS replies,
count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 11 = 0) AS redelivered, greatest(count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')), 0) AS lost,
min(event_id) FILTER (WHERE event_type = 'purchase') AS first_reply FROM events GROUP BY ALL)"""
)
def client_incarnations(spark, sf):
    """Each client's report by the incarnation that answered, in the order of first replies."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.expr("event_id div 2000").alias("incarnation"))
    kind = F.col("event_type")
    return TK.client_reports(rows, ["user_id"], "incarnation", "event_id", kind == "purchase", kind == "error", F.col("event_id") % 11 == 0)


@query("SELECT user_id, count(*) AS asks, count(*) FILTER (WHERE event_type = 'purchase') AS replies, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT event_id // 2000) AS incarnations FROM events GROUP BY 1")
def client_merged(spark, sf):
    """The reports of all incarnations of a client, put together."""
    return client_incarnations(spark, sf).groupBy("user_id").agg(F.sum("asks").alias("asks"), F.sum("replies").alias("replies"), F.sum("errors").alias("errors"), F.count("*").alias("incarnations"))


@query(f"SELECT table_name, column_name, NOT (data_type LIKE 'MAP%' OR data_type LIKE 'UNION%') AS admitted FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})")
def type_admission(spark, sf):
    """Which columns of all tables have types that a store takes."""
    rows = [(name, c.name, S.admitted_type(c.dataType)) for name in TABLES for c in table(spark, sf, name).schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, admitted boolean")


@query(
    """WITH c AS (SELECT l_orderkey, l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS following FROM lineitem), n AS (SELECT max(l_shipdate) AS now FROM lineitem),
t AS (SELECT l_orderkey, count(*) FILTER (WHERE coalesce(following, now) > l_shipdate + INTERVAL 20 DAY) AS lapses FROM c, n GROUP BY 1) SELECT sum(least(lapses, 3))::BIGINT AS requeued, count(*) FILTER (WHERE lapses > 3) AS failed, count(*) AS tasks FROM t"""
)
def task_reap_report(spark, sf):
    """Claims have a lease of 20 days; one that runs out puts the task back, at most three times."""
    claims = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return TK.reap_report(claims, "l_orderkey", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey"], 20)


@query("SELECT count(*) AS actors, count(*) FILTER (WHERE last > (SELECT max(ts) FROM events) - INTERVAL 2 DAY) AS alive FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)")
def actors_alive(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    now = last.agg((F.max("last") - F.make_dt_interval(F.lit(2))).alias("since"))
    return last.crossJoin(F.broadcast(now)).agg(F.count("*").alias("actors"), F.count_if(F.col("last") > F.col("since")).alias("alive"))  # one row


@query("SELECT o_custkey, 1000000 - sum(floor(o_totalprice)::BIGINT) FILTER (WHERE o_orderstatus = 'O') AS unreserved FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') > 0")
def quota_unreserved(spark, sf):
    """What is left of a total after all that is granted."""
    granted = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("granted"))
    return granted.select("o_custkey", (F.lit(1_000_000) - F.col("granted")).alias("unreserved"))


@query("SELECT day, offered, achieved, achieved * 100 >= offered * 95 OR offered = 0 AS sustained FROM (SELECT epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS offered, count(*) FILTER (WHERE event_type != 'error') AS achieved FROM events GROUP BY 1)")
def rate_sustained(spark, sf):
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    per = table(spark, sf, "events").groupBy(day.alias("day")).agg(F.count("*").alias("offered"), F.count_if(F.col("event_type") != "error").alias("achieved"))
    return per.withColumn("sustained", (F.col("achieved") * 100 >= F.col("offered") * 95) | (F.col("offered") == 0))


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber NOT BETWEEN 1 AND 5 THEN 'Invalid' WHEN s_suppkey IS NOT NULL AND s_nationkey % 5 = l_partkey % 5 THEN 'FastPath' ELSE 'ByKey' END AS path
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0"""
)
def ref_paths(spark, sf):
    """References of a kind that exists resolve by their locator if it still leads somewhere and the schemas agree, else by key."""
    live = table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey", (F.col("s_nationkey") % 5).alias("schema"))
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").join(live, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    fast = F.col("s_suppkey").isNotNull() & (F.col("schema") == F.col("l_partkey") % 5)
    return refs.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.when(~F.col("l_linenumber").between(1, 5), "Invalid").when(fast, "FastPath").otherwise("ByKey").alias("path"))


@query(
    """WITH m AS (SELECT user_id, event_id, event_type, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS total, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT 'counter' AS actor, user_id AS key, event_id AS at, 'reply' AS effect, NULL AS target, total::VARCHAR AS body FROM m WHERE event_type = 'view'
UNION ALL SELECT 'counter', user_id, event_id, 'publish', 'tens', n::VARCHAR FROM m WHERE n % 10 = 0 UNION ALL SELECT 'counter', user_id, event_id, 'put', 'total/' || user_id, total::VARCHAR FROM m WHERE n % 25 = 0
UNION ALL SELECT 'counter', user_id, event_id, 'tell', 'sink', total::VARCHAR FROM m WHERE event_type = 'error' UNION ALL SELECT 'sink', user_id, event_id, 'publish', 'errors', row_number() OVER (PARTITION BY user_id ORDER BY event_id) || ':' || total FROM m WHERE event_type = 'error'"""
)
def actor_effects(spark, sf):
    """Two user handlers: a counter replies, publishes, puts objects and tells a sink, which publishes what it is told."""

    def count(state: tuple, at: int, kind: str, body: str) -> tuple[tuple, list]:
        total, n = state[0] + at % 7, state[1] + 1
        out = [("reply", None, str(total))] if kind == "view" else []
        out += [("publish", "tens", str(n))] if n % 10 == 0 else []
        out += [("put", body, str(total))] if n % 25 == 0 else []
        return (total, n), [*out, ("tell", "sink", str(total))] if kind == "error" else out

    def sink(state: tuple, at: int, kind: str, body: str) -> tuple[tuple, list]:
        return (state[0] + 1,), [("publish", "errors", f"{state[0] + 1}:{body}")]

    handlers = {"counter": A.Handler((0, 0), count), "sink": A.Handler((0,), sink, accepts=("tell",))}
    events = table(spark, sf, "events")
    sent = events.select(F.lit("counter").alias("actor"), F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.concat(F.lit("total/"), "user_id").alias("body"))
    return A.host(sent, handlers).where("effect != 'unknown'")


