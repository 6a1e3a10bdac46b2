"""The queries over the driver's tables, each beside the DuckDB SQL that must give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import scalars as S
from tidelog.operators import tasks as TK
from tidelog.operators import topics as TP
from tidelog.operators import versions as V
from tidelog.operators.folds import at_ranks, at_share, numbered
from tidelog.sources.tables import table

BATCH, K, SINCE, HEAD = 100, 8, 20, 60
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOG = f"(SELECT *, event_id // {BATCH} + 1 AS version FROM events)"


def query(sql: str | None):
    """Registers a function under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def log(spark: SparkSession, sf: str) -> DataFrame:
    return V.with_version(table(spark, sf, "events"), "event_id", BATCH)


# Versioned tables


@query(f"SELECT event_id, version, user_id, event_type, value FROM {LOG}")
def snapshot_full(spark, sf):
    return log(spark, sf).select("event_id", "version", "user_id", "event_type", "value")


@query(f"SELECT event_id, version FROM {LOG} WHERE version <= 50")
def snapshot_at_version(spark, sf):
    return V.snapshot_at(log(spark, sf), 50).select("event_id", "version")


@query("SELECT sum(event_id)::BIGINT AS total, count(*) AS n FROM events")
def snapshot_summary(spark, sf):
    return table(spark, sf, "events").agg(F.sum("event_id").alias("total"), F.count("*").alias("n"))


@query(f"SELECT event_id, version FROM {LOG} WHERE version > {SINCE} AND version <= {HEAD}")
def delta_since(spark, sf):
    return V.delta(log(spark, sf), SINCE, HEAD).select("event_id", "version")


@query(
    f"""WITH h AS (SELECT max(version) AS v, (max(version) - 1) // {K} AS j FROM {LOG} l),
s AS (SELECT h.*, unnest(range(0, v + 1)) AS since FROM h),
b AS (SELECT *, CASE WHEN j = 0 THEN 0 WHEN j = 1 THEN 1 ELSE (j - 1) * {K} END AS base, j * {K} + 1 AS root, greatest(1, (j - 1) * {K} + 1) AS oldest FROM s),
t AS (SELECT *, since > 0 AND since < root AND j >= 1 AND since < base AS truncated FROM b)
SELECT since, truncated, count(l.event_id) AS n, coalesce(sum(l.event_id), 0)::BIGINT AS total FROM t LEFT JOIN {LOG} l
ON l.version > CASE WHEN since = 0 OR truncated THEN oldest - 1 ELSE since END AND l.version <= v GROUP BY since, truncated"""
)
def delta_window_matrix(spark, sf):
    """What a reader at every version gets from a table of window width K: rows, their sum, and whether rows are lost."""
    totals = V.running_totals(log(spark, sf), "event_id")
    head = totals.agg(F.max("version").alias("head"), F.max_by("rows_to", "version").alias("rows_all"), F.max_by("sum_to", "version").alias("sum_all"))
    readers = totals.select(F.col("version").alias("since")).unionByName(head.select(F.lit(0).cast("long").alias("since"))).crossJoin(F.broadcast(head))  # one row
    first = readers.withColumn("truncated", V.window_truncated(F.col("since"), F.col("head"), K)).withColumn("before", V.window_first_read(F.col("since"), F.col("head"), K) - 1)
    joined = first.join(totals.withColumnRenamed("version", "before"), "before", "left")
    return joined.select("since", "truncated", (F.col("rows_all") - F.coalesce("rows_to", F.lit(0))).alias("n"), (F.col("sum_all") - F.coalesce("sum_to", F.lit(0))).alias("total"))


@query(f"SELECT DISTINCT version, CASE WHEN (version - 1) % {K} = 0 THEN 'Window' ELSE 'Append' END AS kind FROM {LOG}")
def window_policy_kinds(spark, sf):
    return log(spark, sf).select("version").distinct().select("version", V.window_kind(F.col("version"), K).alias("kind"))


@query(
    f"""WITH h AS (SELECT DISTINCT version AS head, greatest(1, ((version - 1) // {K} - 1) * {K} + 1) AS oldest FROM {LOG})
SELECT head, oldest, count(*) AS n_rows FROM h JOIN {LOG} l ON l.version BETWEEN oldest AND head GROUP BY head, oldest"""
)
def window_live_rows(spark, sf):
    totals = V.running_totals(log(spark, sf), "event_id").select("version", "rows_to")
    heads = totals.select(F.col("version").alias("head"), "rows_to").withColumn("oldest", V.window_oldest(F.col("head"), K))
    before = totals.select((F.col("version") + 1).alias("oldest"), F.col("rows_to").alias("gone"))
    return heads.join(before, "oldest", "left").select("head", "oldest", (F.col("rows_to") - F.coalesce("gone", F.lit(0))).alias("n_rows"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def replace_latest_per_key(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return V.latest_per_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def version_numbering(spark, sf):
    return V.number_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"SELECT version, CASE WHEN version % 10 = 0 THEN 0 ELSE count(*) END AS n_rows, CASE WHEN version % 10 = 0 THEN 'VersionGone' ELSE 'OK' END AS status FROM {LOG} GROUP BY version")
def evict_current_empty(spark, sf):
    """Every tenth version evicts: it can be pinned and holds no rows."""
    evicted = F.col("version") % 10 == 0
    sizes = log(spark, sf).groupBy("version").agg(F.count("*").alias("n"))
    return sizes.select("version", F.when(evicted, 0).otherwise(F.col("n")).cast("long").alias("n_rows"), F.when(evicted, "VersionGone").otherwise("OK").alias("status"))


CAS_SQL = """WITH RECURSIVE a AS (SELECT {0} AS k0, {1} AS id, row_number() OVER (PARTITION BY {0} ORDER BY {2}) AS k FROM {3}), e AS (SELECT *, {4} AS expect FROM a),
w AS (SELECT k0, id, k, expect, 0::BIGINT AS before FROM e WHERE k = 1 UNION ALL SELECT e.k0, e.id, e.k, e.expect, w.before + (w.expect = w.before)::BIGINT FROM w JOIN e ON e.k0 = w.k0 AND e.k = w.k + 1)
SELECT k0 AS {0}, id AS {1}, expect, CASE WHEN expect != before THEN 'VersionMismatch' WHEN before = 0 THEN 'created' ELSE 'installed' END AS status, before + (expect = before)::BIGINT AS actual FROM w"""


@query(CAS_SQL.format("user_id", "event_id", "event_id", "events", "(k * 3) // 4"))
def optimistic_conflict(spark, sf):
    """Optimistic commits: each names the version that it expects; who finds another one conflicts."""
    attempts = numbered(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "k").withColumn("expect", F.floor(F.col("k") * 3 / 4))
    return V.put_if(attempts, "user_id", ["event_id"], "expect", ["user_id", "event_id", "expect"])


@query(
    """WITH RECURSIVE a AS (SELECT user_id, epoch(ts)::BIGINT AS t0, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS k FROM events),
w AS (SELECT user_id, k, t0 + 86400 AS until, 1::BIGINT AS granted, 0::BIGINT AS locked FROM a WHERE k = 1
UNION ALL SELECT a.user_id, a.k, CASE WHEN a.t0 >= w.until THEN a.t0 + 86400 ELSE w.until END, w.granted + (a.t0 >= w.until)::BIGINT, w.locked + (a.t0 < w.until)::BIGINT FROM w JOIN a ON a.user_id = w.user_id AND a.k = w.k + 1)
SELECT user_id, max(granted) AS granted, max(locked) AS write_locked FROM w GROUP BY user_id"""
)
def exclusive_lease(spark, sf):
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")  # to the nearest second, as the cast of the SQL
    return TK.exclusive_leases(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", ["event_id"], at, 86400)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def stream_txn_visible(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return V.committed_only(events, events.where("event_type = 'purchase'"), "user_id").select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN event_type = first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 'staged' ELSE 'SchemaMismatch' END AS status FROM events")
def schema_mismatch_reject(spark, sf):
    """A transaction takes the schema of its first batch; a second one is refused."""
    first = F.first("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == first, "staged").otherwise("SchemaMismatch").alias("status"))


INTERN_SQL = "SELECT {0}, min(event_id) AS first_seen, row_number() OVER (ORDER BY min(event_id), {0}) AS id FROM events GROUP BY {0}"


@query(INTERN_SQL.format("event_type"))
def schema_interning(spark, sf):
    return V.interned(table(spark, sf, "events"), "event_type", "event_id")


@query(INTERN_SQL.format("user_id"))
def key_interning(spark, sf):
    return V.interned(table(spark, sf, "events"), "user_id", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def catalog_live(spark, sf):
    """Keys created and not tombstoned."""
    dead = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(dead, "c_custkey", "left_anti")


@query(
    """SELECT l_partkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'NotFound' WHEN l_linenumber != version THEN 'VersionMismatch' ELSE 'OK' END AS status, count(*) AS n
FROM lineitem LEFT JOIN (SELECT p_partkey, p_size % 7 + 1 AS version FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY ALL"""
)
def typed_ref_resolve(spark, sf):
    """References name a part and the version that they mean; live parts have their current one."""
    live = table(spark, sf, "part").where("p_size <= 25").select("p_partkey", (F.col("p_size") % 7 + 1).alias("version"))
    refs = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber").join(live, F.col("l_partkey") == F.col("p_partkey"), "left")
    status = F.when(F.col("p_partkey").isNull(), "NotFound").when(F.col("l_linenumber") != F.col("version"), "VersionMismatch").otherwise("OK")
    return refs.groupBy("l_partkey", "l_linenumber", status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, length(text) AS size FROM documents")
def object_versions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.length("text").cast("long").alias("size"))
    return numbered(docs, ["source"], "doc_id", "version")


@query("SELECT page_id, i AS segment, length(substr(html, i * 4096 + 1, 4096)) AS size, md5(substr(html, i * 4096 + 1, 4096)) AS digest FROM (SELECT page_id, html, unnest(range(0, greatest(1, (length(html) + 4095) // 4096))) AS i FROM pages)")
def object_segments(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.length("html") / 4096), F.lit(1)) - 1)).alias("segment"))
    part = F.substring("html", (F.col("segment") * 4096 + 1).cast("int"), F.lit(4096))
    return pages.select("page_id", "segment", F.length(part).cast("long").alias("size"), F.md5(part).alias("digest"))


@query(
    """WITH s AS (SELECT page_id, html, list_transform(range(0, greatest(1, (length(html) + 4095) // 4096)), lambda i: substr(html, i * 4096 + 1, 4096)) AS parts FROM pages)
SELECT page_id, len(parts)::BIGINT AS n_segments, list_sum(list_transform(parts, lambda p: length(p)))::BIGINT AS size, array_to_string(parts, '') = html AS equal FROM s"""
)
def object_roundtrip(spark, sf):
    """Cut and put together again."""
    pages = table(spark, sf, "pages").select("page_id", "html", F.sequence(F.lit(0), F.greatest(F.ceil(F.length("html") / 4096), F.lit(1)).cast("int") - 1).alias("_k"))
    parts = pages.withColumn("_parts", F.transform("_k", lambda k: F.substring(F.col("html"), k * 4096 + 1, F.lit(4096))))
    return parts.select("page_id", F.size("_parts").cast("long").alias("n_segments"), F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p)).alias("size"), (F.array_join("_parts", "") == F.col("html")).alias("equal"))


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 404 WHEN open = 0 THEN 410 ELSE 200 END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def object_status(spark, sf):
    """200 with a current version, 410 with former ones only, 404 with none."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    known = table(spark, sf, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return known.select("c_custkey", F.when(F.col("n").isNull(), 404).when(F.col("open") == 0, 410).otherwise(200).alias("status"))


@query(CAS_SQL.format("o_custkey", "o_orderkey", "o_orderdate, o_orderkey", "orders", "((k - 1) * 2) // 3 + (id % 5 = 0)::BIGINT"))
def object_put_if(spark, sf):
    """Compare and set: a put names the version that it expects, 0 to create."""
    puts = V.number_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "k")
    expect = F.floor((F.col("k") - 1) * 2 / 3) + (F.col("o_orderkey") % 5 == 0).cast("long")
    return V.put_if(puts.withColumn("expect", expect), "o_custkey", ["o_orderdate", "o_orderkey"], "expect", ["o_custkey", "o_orderkey", "expect"])


# Rings and topics

HEADS = "SELECT max(event_id) + 1 AS head FROM events"


@query(
    f"""WITH u AS (SELECT user_id, min(event_id) * 3 AS cursor FROM events GROUP BY user_id), h AS ({HEADS})
SELECT user_id, cursor, CASE WHEN cursor >= head THEN 'empty' WHEN head - cursor > 4096 THEN 'lagged' ELSE 'sample' END AS status,
CASE WHEN cursor < head AND head - cursor > 4096 THEN head - 4096 - cursor ELSE 0 END AS skipped, CASE WHEN cursor >= head THEN cursor WHEN head - cursor > 4096 THEN head - 4096 ELSE cursor + 1 END AS new_cursor FROM u, h"""
)
def ring_lag(spark, sf):
    events = table(spark, sf, "events")
    head = events.agg((F.max("event_id") + 1).alias("head"))
    cursors = events.groupBy("user_id").agg((F.min("event_id") * 3).alias("cursor")).crossJoin(F.broadcast(head))  # one row
    status, skipped, after = TP.ring_read(F.col("cursor"), F.col("head"), 4096)
    return cursors.select("user_id", "cursor", status.alias("status"), skipped.alias("skipped"), after.alias("new_cursor"))


@query(
    """WITH c AS (SELECT event_type, user_id, max(event_id) AS cursor FROM events GROUP BY ALL), h AS (SELECT event_type, max(event_id) AS head FROM events GROUP BY 1)
SELECT event_type, head, min(cursor) AS slowest, head - min(cursor) > 4096 AS pressed FROM c JOIN h USING (event_type) GROUP BY event_type, head"""
)
def ring_backpressure(spark, sf):
    cursors = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("cursor"))
    per = cursors.groupBy("event_type").agg(F.max("cursor").alias("head"), F.min("cursor").alias("slowest"))
    return per.withColumn("pressed", F.col("head") - F.col("slowest") > 4096)


SEQ = "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events)"


@query(
    f"""WITH m AS (SELECT event_type, min(seq) AS first, max(seq) AS last FROM {SEQ} WHERE seq > 50 GROUP BY 1), c AS (SELECT unnest([0, 1, 49, 50, 51, 100, 5000000]) AS cursor)
SELECT event_type, cursor::BIGINT AS cursor, (CASE WHEN first > cursor + 1 THEN first - 1 ELSE cursor END)::BIGINT AS from_seq, first > cursor + 1 AS truncated, greatest(0, last - CASE WHEN first > cursor + 1 THEN first - 1 ELSE cursor END)::BIGINT AS n_messages FROM m, c"""
)
def topic_read_since(spark, sf):
    kept = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id").where("seq > 50")
    asked = kept.select("event_type").distinct().withColumn("cursor", F.explode(F.lit([0, 1, 49, 50, 51, 100, 5000000]).cast("array<long>")))
    return TP.read_since(kept, asked, "event_type")


@query("SELECT event_type, count(*) AS head FROM events GROUP BY event_type")
def topic_head(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("head"))


@query(
    f"""SELECT event_type, seq, before::BIGINT AS before FROM (SELECT event_type, seq, coalesce(sum(length(props)) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
row_number() OVER (PARTITION BY event_type ORDER BY seq) AS n FROM {SEQ} WHERE seq > 10) WHERE before < 4096 AND n <= 1024"""
)
def topic_longpoll(spark, sf):
    messages = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type", "props"), "event_type", "event_id")
    sent = TP.within_budget(messages, "event_type", F.length("props"), 4096, 1024, after=10)
    return sent.select("event_type", "seq", F.col("_before").alias("before"))


#: Messages with some lines more, some bytes that are not UTF-8, some without a name.
MESSAGE = """(SELECT event_type, seq, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS event, 'text/plain; q="' || user_id || '"' AS content_type,
CASE WHEN event_id % 7 = 0 THEN props || chr(10) || 'more' || chr(9) || chr(92) || chr(1) ELSE props END AS body, event_id % 10 = 3 AS raw FROM {0})"""


def _messages(spark, sf):
    m = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts", "props"), "event_type", "event_id")
    body = F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("\nmore\t\\\x01"))).otherwise(F.col("props")).cast("binary")
    data = F.when(F.col("event_id") % 10 == 3, F.concat(F.unhex(F.lit("FF")), body)).otherwise(body)
    event = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type"))
    return m.select("event_type", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), event.alias("event"), F.concat(F.lit('text/plain; q="'), "user_id", F.lit('"')).alias("content_type"), data.alias("data"))


@query(
    f"""SELECT event_type, seq, 'id: ' || seq || chr(10) || CASE WHEN event != '' THEN 'event: ' || event || chr(10) ELSE '' END || CASE WHEN raw THEN ':b64' || chr(10) || 'data: ' || to_base64('\\xFF'::BLOB || encode(body)) || chr(10)
ELSE 'data: ' || replace(body, chr(10), chr(10) || 'data: ') || chr(10) END || chr(10) AS frame FROM {MESSAGE.format(SEQ)}"""
)
def topic_sse(spark, sf):
    return _messages(spark, sf).select("event_type", "seq", TP.sse_frame(F.col("seq"), F.col("event"), F.col("data")).alias("frame"))


ESCAPED = """replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(1), chr(92) || 'u0001')"""


@query(
    f"""SELECT event_type, seq, '{{"seq":' || seq || ',"ts_ms":' || ts_ms || ',"event":"' || event || '","content_type":"' || {ESCAPED.format("content_type")} || '",' || CASE WHEN raw THEN '"data_b64":"' || to_base64('\\xFF'::BLOB || encode(body)) ELSE '"data":"' || {ESCAPED.format("body")} END || '"}}' || chr(10) AS line
FROM {MESSAGE.format(SEQ)}"""
)
def topic_ndjson(spark, sf):
    line = TP.json_line(F.col("seq"), F.col("ts_ms"), F.col("event"), F.col("content_type"), F.col("data"))
    return _messages(spark, sf).select("event_type", "seq", line.alias("line"))


@query("WITH c AS (SELECT event_type, user_id, min(event_id) AS cursor FROM events GROUP BY ALL) SELECT event_type, user_id, cursor, min(cursor) OVER (PARTITION BY event_type) AS read_from FROM c")
def topic_fanout_min_cursor(spark, sf):
    """One read a topic, from its slowest subscriber, serves all."""
    cursors = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("cursor"))
    return cursors.join(cursors.groupBy("event_type").agg(F.min("cursor").alias("read_from")), "event_type")


@query(f"SELECT user_id, event_type, count(*) AS got, coalesce(sum((seq != p + 1)::INT), 0)::BIGINT AS gaps FROM (SELECT user_id, event_type, seq, lag(seq) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS p FROM {SEQ}) GROUP BY ALL")
def topic_gaps(spark, sf):
    got = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_type", "event_id")
    return TP.gaps(got, ["user_id", "event_type"], "seq")


@query(
    """SELECT page_id, regexp_full_match(n, '[A-Za-z0-9._-]{1,32}') AS topic, regexp_full_match(n, '[A-Za-z0-9._-]{0,16}') AS event, regexp_full_match(n, '[A-Za-z0-9._/-]{1,256}') AS key, regexp_full_match(n, '[ -~]{0,128}') AS content
FROM (SELECT page_id, substr(url, 1 + (page_id % 9)::INT, (page_id % 40)::INT) AS n FROM pages)"""
)
def name_validation(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.substring("url", (F.col("page_id") % 9 + 1).cast("int"), (F.col("page_id") % 40).cast("int")).alias("n"))
    n = F.col("n")
    return names.select("page_id", S.is_topic_name(n).alias("topic"), S.is_event_name(n).alias("event"), S.is_object_key(n).alias("key"), S.is_content_type(n).alias("content"))


@query(ORACLE_SQL["window_live_rows"])
def window_from_log_fold(spark, sf):
    """What window_live_rows has in closed form, from the kinds of the commits."""
    totals = V.running_totals(log(spark, sf), "event_id").select("version", "rows_to")
    kinds = totals.select("version", V.window_kind(F.col("version"), K).alias("kind"), F.lit(K).alias("keep"))
    first = kinds.withColumn("kind", F.when(F.col("version") == 1, "Replace").otherwise(F.col("kind")))
    heads = V.commit_states(first, []).select(F.col("version").alias("head"), F.col("low").alias("oldest")).join(totals.withColumnRenamed("version", "head"), "head")
    before = totals.select((F.col("version") + 1).alias("oldest"), F.col("rows_to").alias("gone"))
    return heads.join(before, "oldest", "left").select("head", "oldest", (F.col("rows_to") - F.coalesce("gone", F.lit(0))).alias("n_rows"))


# Tasks

STEP = "CASE event_id % 6 WHEN 0 THEN 'claim' WHEN 1 THEN 'complete' WHEN 2 THEN 'lapse' WHEN 3 THEN 'claim' WHEN 4 THEN 'fail' ELSE 'cancel' END"
TASK = "(user_id * 7 + event_id // 64)"


def task_events(spark, sf):
    what = F.expr(STEP)
    return table(spark, sf, "events").select(F.expr("user_id * 7 + event_id div 64").alias("task"), "event_id", what.alias("what"))


@query(
    f"""WITH RECURSIVE e AS (SELECT {TASK} AS task, {STEP} AS what, row_number() OVER (PARTITION BY {TASK} ORDER BY event_id) AS k FROM events),
w AS (SELECT task, 0::BIGINT AS k, 'QUEUED' AS state FROM e WHERE k = 1 UNION ALL SELECT e.task, e.k, CASE WHEN state IN ('DONE', 'FAILED', 'CANCELLED') THEN state WHEN what = 'claim' AND state = 'QUEUED' THEN 'CLAIMED'
WHEN what = 'complete' AND state = 'CLAIMED' THEN 'DONE' WHEN what = 'fail' AND state = 'CLAIMED' THEN 'FAILED' WHEN what = 'cancel' AND state = 'QUEUED' THEN 'CANCELLED' WHEN what = 'lapse' AND state = 'CLAIMED' THEN 'QUEUED' ELSE state END
FROM w JOIN e ON e.task = w.task AND e.k = w.k + 1) SELECT task, arg_max(state, k) AS state, max(k) AS n_events FROM w GROUP BY task"""
)
def task_fold_status(spark, sf):
    return TK.folded(task_events(spark, sf), "task", "event_id", "what")


@query(f"SELECT event_id, {TASK} AS task, row_number() OVER (PARTITION BY {TASK} ORDER BY event_id) = 1 AS won FROM events WHERE event_id % 3 = 0")
def task_claim_first(spark, sf):
    claims = table(spark, sf, "events").where("event_id % 3 = 0").select("event_id", F.expr("user_id * 7 + event_id div 64").alias("task"))
    return TK.first_claims(claims, ["task"], "event_id")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS lapses, least(count(*) FILTER (WHERE l_returnflag = 'R') + 1, 4) AS attempts, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 3 THEN 'FAILED' ELSE 'DONE' END AS outcome FROM lineitem GROUP BY 1")
def task_reap_retry(spark, sf):
    lapsed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("lapses"))
    return TK.reaped(lapsed, "lapses")


@query(f"SELECT {TASK} AS task, CASE WHEN min(event_id) FILTER (WHERE event_id % 5 = 1) < coalesce(min(event_id) FILTER (WHERE event_id % 5 = 0), 9e18) THEN 'CANCELLED' WHEN count(*) FILTER (WHERE event_id % 5 = 1) > 0 THEN 'flagged' ELSE 'none' END AS outcome FROM events GROUP BY 1")
def task_cancel(spark, sf):
    """Before the first claim a cancel ends the task; after it the worker gets a flag."""
    e = table(spark, sf, "events").select(F.expr("user_id * 7 + event_id div 64").alias("task"), "event_id")
    times = e.groupBy("task").agg(F.min(F.when(F.col("event_id") % 5 == 1, F.col("event_id"))).alias("c"), F.min(F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).alias("k"))
    return times.select("task", F.when(F.col("c") < F.coalesce("k", F.lit(9e18)), "CANCELLED").when(F.col("c").isNotNull(), "flagged").otherwise("none").alias("outcome"))


@query(
    """WITH w AS (SELECT l_orderkey, max(l_shipdate) AS acked FROM lineitem WHERE l_returnflag != 'R' GROUP BY 1), n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT o_orderkey, CASE WHEN acked <= o_orderdate + INTERVAL 60 DAY THEN 'released' WHEN now > o_orderdate + INTERVAL 90 DAY AND o_orderstatus != 'O' THEN 'reaped' ELSE 'held' END AS binding FROM orders LEFT JOIN w ON l_orderkey = o_orderkey, n"""
)
def task_bindings(spark, sf):
    """A claim has a lease of 60 days. Acknowledged within it, its bindings are released; past it and 30 days of grace, those of tasks that cannot run are reaped."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    acks = table(spark, sf, "lineitem").where("l_returnflag != 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("acked"))
    now = orders.agg(F.max("o_orderdate").alias("now"))
    return TK.bindings(orders.join(acks, "o_orderkey", "left").crossJoin(F.broadcast(now)), "o_orderdate", "acked", "now", F.col("o_orderstatus") == "O", 60, 30).select("o_orderkey", "binding")  # one row


ADMIT_SQL = """WITH RECURSIVE a AS (SELECT {0} AS h, CASE WHEN event_id % 3 = 2 THEN -1 ELSE 1 END AS d, row_number() OVER (PARTITION BY {0} ORDER BY event_id) AS k FROM events),
w AS (SELECT h, 0::BIGINT AS k, 0::BIGINT AS out, 0::BIGINT AS granted, 0::BIGINT AS refused FROM a WHERE k = 1 UNION ALL
SELECT a.h, a.k, CASE WHEN d > 0 AND out < {1} THEN out + 1 WHEN d < 0 AND out > 0 THEN out - 1 ELSE out END, granted + (d > 0 AND out < {1})::BIGINT, refused + (d > 0 AND out >= {1})::BIGINT FROM w JOIN a ON a.h = w.h AND a.k = w.k + 1)
SELECT h AS {0}, arg_max(granted, k) AS granted, arg_max(refused, k) AS refused, arg_max(out, k) AS outstanding FROM w GROUP BY h"""


def _changes(spark, sf, key):
    return table(spark, sf, "events").select(key, "event_id", F.when(F.col("event_id") % 3 == 2, -1).otherwise(1).alias("change"))


@query(ADMIT_SQL.format("user_id", 4))
def quota_admission(spark, sf):
    return TK.admitted(_changes(spark, sf, "user_id"), "user_id", "event_id", "change", 4)


@query(ADMIT_SQL.format("event_type", 64))
def task_backpressure(spark, sf):
    return TK.admitted(_changes(spark, sf, "event_type"), "event_type", "event_id", "change", 64)


@query("SELECT a.event_id, a.user_id FROM events a WHERE a.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.event_id // 500 = a.event_id // 500)")
def journal_replay(spark, sf):
    """What a dead holder acquired and did not release."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 500").alias("epoch"))
    released = e.where("event_type = 'purchase'").select("user_id", "epoch")
    return e.where("event_type = 'click'").join(released, ["user_id", "epoch"], "left_anti").select("event_id", "user_id")


@query("SELECT event_id, user_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts > INTERVAL 1 DAY AS died FROM events")
def lease_deaths(spark, sf):
    """A holder is dead when its next heartbeat comes too late; the last one tells nothing."""
    at = F.col("ts").cast("timestamp")
    following = F.lead(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(following) - F.unix_micros(at) > 86_400_000_000).alias("died"))


# Actors


@query(
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN turn % 3 = 0 THEN 'UnknownSchema' ELSE 'handled' END WHEN 'assistant' THEN 'handled' ELSE 'NoSuchActor' END AS status FROM conversations"""
)
def actor_route(spark, sf):
    actors = spark.createDataFrame([("user",), ("assistant",)], "role string")
    handlers = spark.createDataFrame([("user", 1), ("user", 2), ("assistant", 0), ("assistant", 1), ("assistant", 2)], "role string, kind int")
    m = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.col("turn") % 3).cast("int").alias("kind"))
    routed = m.join(F.broadcast(actors.withColumn("_actor", F.lit(True))), "role", "left").join(F.broadcast(handlers.withColumn("_handler", F.lit(True))), ["role", "kind"], "left")  # literals
    return routed.select("conv_id", "turn", F.when(F.col("_actor").isNull(), "NoSuchActor").when(F.col("_handler").isNull(), "UnknownSchema").otherwise("handled").alias("status"))


@query("SELECT event_type, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(event_type, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS id FROM (SELECT DISTINCT event_type FROM events)")
def actor_id_hash(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", S.fnv1a_32(F.col("event_type")).alias("id"))


@query("SELECT event_id, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events QUALIFY event_type = 'view'")
def actor_counter(spark, sf):
    """Adds arrive from all events; a view reads the sum so far."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").withColumn("total", F.sum(F.col("event_id") % 7).over(w)).where("event_type = 'view'").select("event_id", "total")


@query(f"SELECT event_type, seq, event_id || ':' || user_id AS body FROM {SEQ}")
def actor_sink(spark, sf):
    sent = TP.sequenced(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_type", "event_id")
    return sent.select("event_type", "seq", F.concat_ws(":", "event_id", "user_id").alias("body"))


@query("SELECT p_partkey, unnest(range(p_partkey, p_partkey + p_size % 5)) AS handle FROM part")
def range_expand(spark, sf):
    ranges = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5).cast("long").alias("n"))
    return TP.expanded_ranges(ranges, "p_partkey", "n", "handle").select("p_partkey", "handle")


@query("SELECT user_id, min(event_id) AS first, count(*) AS n FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g")
def range_coalesce(spark, sf):
    return TP.coalesced_ranges(table(spark, sf, "events"), ["user_id"], "event_id")


# Prices

GRID = "(SELECT i::BIGINT AS i, 0.25::DOUBLE + i::DOUBLE * 29.75::DOUBLE / 63 AS tenor, 0.03::DOUBLE + 0.0002::DOUBLE * i AS rate FROM range(64) t(i))"


def curve(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("double")
    return spark.range(64).select(F.col("id").alias("i"), (F.lit(0.25) + i * 29.75 / 63).alias("tenor"), (F.lit(0.03) + F.lit(0.0002) * i).alias("rate"))


@query(f"SELECT * FROM {GRID}")
def curve_grid(spark, sf):
    return curve(spark)


PRICED = f"""SELECT o_orderkey, o_totalprice AS notional, (o_orderkey % 3500)::DOUBLE / 100 AS tenor,
CASE WHEN (o_orderkey % 3500)::DOUBLE / 100 <= (SELECT min(tenor) FROM {GRID}) THEN (SELECT arg_min(rate, tenor) FROM {GRID}) WHEN (o_orderkey % 3500)::DOUBLE / 100 > (SELECT max(tenor) FROM {GRID}) THEN (SELECT arg_max(rate, tenor) FROM {GRID})
ELSE s.r0 + ((o_orderkey % 3500)::DOUBLE / 100 - s.t0) / (s.t1 - s.t0) * (s.r1 - s.r0) END AS rate
FROM orders LEFT JOIN (SELECT tenor AS t0, rate AS r0, lead(tenor) OVER (ORDER BY tenor) AS t1, lead(rate) OVER (ORDER BY tenor) AS r1 FROM {GRID}) s ON (o_orderkey % 3500)::DOUBLE / 100 > t0 AND (o_orderkey % 3500)::DOUBLE / 100 <= t1"""


def priced(spark, sf):
    """Requests with their rate: the curve is 64 points, one array beside each row."""
    points = curve(spark).agg(F.sort_array(F.collect_list(F.struct("tenor", "rate"))).alias("_curve"))
    asks = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("notional"), ((F.col("o_orderkey") % 3500).cast("double") / 100).alias("tenor"))
    rated = asks.crossJoin(F.broadcast(points))  # one row of 64 points
    return rated.select("o_orderkey", "notional", "tenor", S.interpolated(F.col("_curve"), F.col("tenor")).alias("rate"))


@query(f"SELECT o_orderkey, round(rate, 9) AS rate, round(notional * exp(-rate * tenor), 4) AS price, round((notional * exp(-(rate + 0.0001) * tenor) - notional * exp(-(rate - 0.0001) * tenor)) / 2, 4) AS dv01 FROM ({PRICED})")
def curve_price_dv01(spark, sf):
    r, t, n = F.col("rate"), F.col("tenor"), F.col("notional")
    return priced(spark, sf).select("o_orderkey", F.round(r, 9).alias("rate"), F.round(S.discount_price(r, t, n), 4).alias("price"), F.round(S.dv01(r, t, n), 4).alias("dv01"))


@query(
    f"""SELECT o_orderkey, abs((notional * exp(-(rate + 0.0001) * tenor) - notional * exp(-(rate - 0.0001) * tenor)) / 2 + notional * exp(-rate * tenor) * sinh(tenor / 10000)) <= greatest(abs(notional * exp(-rate * tenor)), 1) * 1e-9 AS holds,
round(notional * exp(-rate * tenor) * sinh(tenor / 10000), 4) AS loss FROM ({PRICED})"""
)
def dv01_check(spark, sf):
    """The closed form: minus the price times sinh(t / 10000)."""
    r, t, n = F.col("rate"), F.col("tenor"), F.col("notional")
    px = S.discount_price(r, t, n)
    holds = F.abs(S.dv01(r, t, n) + px * F.sinh(t * 1e-4)) <= F.greatest(F.abs(px), F.lit(1.0)) * 1e-9
    return priced(spark, sf).select("o_orderkey", holds.alias("holds"), F.round(px * F.sinh(t * 1e-4), 4).alias("loss"))


@query("SELECT event_id, event_id * 2 AS doubled FROM events")
def double_column(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("event_id") * 2).alias("doubled"))


# Reports


@query("SELECT event_type, count(*) AS n, min(value) AS low, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_summary(spark, sf):
    """Nearest-rank percentiles, no interpolation."""
    events = table(spark, sf, "events").select("event_type", "value")
    rest = events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    return rest.join(at_share(events, ["event_type"], "value", {"p50": 0.5, "p99": 0.99}), "event_type")


@query(
    """SELECT user_id, count(*) AS asks, count(*) FILTER (WHERE event_type = 'purchase') AS replies, count(*) FILTER (WHERE event_type = 'error') AS errors,
greatest(count(*) - count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error'), 0) AS lost, sum((c)::INT)::BIGINT AS changes FROM
(SELECT *, coalesce(event_type != lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS c FROM events) GROUP BY 1"""
)
def client_report(spark, sf):
    changed = F.coalesce(F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(False))
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type").withColumn("_c", changed)
    replies, errors = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.count("*").alias("asks"), replies.alias("replies"), errors.alias("errors"), F.greatest(F.count("*") - replies - errors, F.lit(0)).alias("lost"), F.sum(F.col("_c").cast("long")).alias("changes"))


@query("SELECT o_custkey, count(*) AS changes FROM (SELECT o_custkey, o_orderstatus != lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS c FROM orders) WHERE c GROUP BY 1")
def version_changes(spark, sf):
    changed = F.col("o_orderstatus") != F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", changed.alias("c")).where("c").groupBy("o_custkey").agg(F.count("*").alias("changes"))


@query(
    """WITH s AS (SELECT event_type, user_id, count(*) AS got, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL)
SELECT event_type, sum(got)::BIGINT AS got, list_sort(list(p50))[count(*) // 2 + 1] AS p50, list_sort(list(p99))[count(*) // 2 + 1] AS p99, max(p99) AS worst_p99 FROM s GROUP BY 1"""
)
def fanout_rollup(spark, sf):
    """Over the subscribers' own percentiles: the element at half of the sorted list, and the worst."""
    events = table(spark, sf, "events").select("event_type", "user_id", "value")
    lists = at_share(events, ["event_type", "user_id"], "value", {"p50": 0.5, "p99": 0.99}).unpivot("event_type", ["p50", "p99"], "of", "own")
    found = at_ranks(lists, ["event_type", "of"], "own", {"half": lambda n, values: F.floor(n / 2) + 1, "worst": lambda n, values: values})
    of = lambda name, share: F.max(F.when(F.col("of") == share, F.col(name)))
    rolled = found.groupBy(F.col("event_type").alias("_type")).agg(of("half", "p50").alias("p50"), of("half", "p99").alias("p99"), of("worst", "p99").alias("worst_p99"))
    got = events.groupBy("event_type").agg(F.count("*").alias("got"))
    return got.join(rolled, F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


@query(
    """SELECT o_orderkey, CASE WHEN r >= 1e9 THEN printf('%.2f G/s', r / 1e9) WHEN r >= 1e6 THEN printf('%.2f M/s', r / 1e6) WHEN r >= 1e3 THEN printf('%.2f K/s', r / 1e3) ELSE printf('%.1f /s', r) END AS rate
FROM (SELECT o_orderkey, pow(10, o_orderkey % 11) * (1 + (o_orderkey % 8) / 8.0::DOUBLE) AS r FROM orders)"""
)
def rate_format(spark, sf):
    rate = F.pow(F.lit(10.0), F.col("o_orderkey") % 11) * (1 + (F.col("o_orderkey") % 8) / 8)
    return table(spark, sf, "orders").select("o_orderkey", S.formatted_rate(rate).alias("rate"))


CLASSES = [64 << k for k in range(9)]


@query("SELECT doc_id, (SELECT min(c) FROM (SELECT 64 * (1 << k) AS c FROM range(9) t(k)) WHERE c >= n)::BIGINT AS class FROM (SELECT doc_id, length(text) AS n FROM documents)")
def pool_class_fit(spark, sf):
    """The smallest class that holds an object; none if all are smaller."""
    classes = F.lit(CLASSES).cast("array<long>")
    return table(spark, sf, "documents").select("doc_id", F.array_min(F.filter(classes, lambda c: c >= F.length("text"))).alias("class"))


@query("SELECT doc_id, n, arg_max(c, (least((c - 64) // 28, 1000) * (c - 32), c))::BIGINT AS class FROM (SELECT doc_id, length(text) AS n FROM documents), (SELECT 64 * (1 << k) AS c FROM range(9) t(k)) WHERE c >= 128 GROUP BY doc_id, n")
def object_pool_shape(spark, sf):
    """The class with the highest ceiling, the larger of two equal ones."""
    shapes = F.transform(F.filter(F.lit(CLASSES).cast("array<long>"), lambda c: c >= 128), lambda c: F.struct((F.least(F.floor((c - 64) / 28), F.lit(1000)) * (c - 32)).alias("ceiling"), c.alias("class")))
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.array_max(shapes)["class"].alias("class"))


@query("SELECT class, count(*) AS n, sum(n)::BIGINT AS used, (sum(class) - sum(n))::BIGINT AS slack FROM (SELECT length(text) AS n, (SELECT min(c) FROM (SELECT 64 * (1 << k) AS c FROM range(9) t(k)) WHERE c >= length(text))::BIGINT AS class FROM documents) WHERE class IS NOT NULL GROUP BY class")
def pool_census(spark, sf):
    """Documents by the size class that holds them."""
    classes = F.lit(CLASSES).cast("array<long>")
    fit = table(spark, sf, "documents").select(F.length("text").cast("long").alias("n")).withColumn("class", F.array_min(F.filter(classes, lambda c: c >= F.col("n")))).where("class IS NOT NULL")
    return fit.groupBy("class").agg(F.count("*").alias("n"), F.sum("n").alias("used"), (F.sum("class") - F.sum("n")).alias("slack"))


@query(
    """WITH RECURSIVE b AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w AS (SELECT source, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS chunks, 0::BIGINT AS refused FROM b WHERE k = 1 UNION ALL
SELECT b.source, b.k, CASE WHEN n > 8192 THEN used WHEN chunks > 0 AND used + (n + 63) // 64 * 64 <= 8192 THEN used + (n + 63) // 64 * 64 ELSE (n + 63) // 64 * 64 END,
chunks + (n <= 8192 AND NOT (chunks > 0 AND used + (n + 63) // 64 * 64 <= 8192))::BIGINT, refused + (n > 8192)::BIGINT FROM w JOIN b ON b.source = w.source AND b.k = w.k + 1)
SELECT source, arg_max(chunks, k) AS chunks, arg_max(used, k)::BIGINT AS last_used, arg_max(refused, k) AS refused FROM w GROUP BY source"""
)
def buffer_packing(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return TK.packed_buffers(docs, "source", "doc_id", "n", 8192)


@query("SELECT event_id, (user_id << 32) | event_id AS ref, user_id AS segment, event_id AS off, (event_id + 63) // 64 * 64 AS aligned FROM events")
def ref_pack_unpack(spark, sf):
    ref = S.packed_ref(F.col("user_id"), F.col("event_id"))
    packed = table(spark, sf, "events").select("event_id", ref.alias("ref"))
    return packed.select("event_id", "ref", S.ref_segment(F.col("ref")).alias("segment"), S.ref_offset(F.col("ref")).alias("off"), S.aligned(F.col("event_id"), 64).alias("aligned"))


@query(
    """WITH r AS (SELECT event_id, event_type FROM events), n AS (SELECT {'event_id': event_id, 'tag': 't' || event_type} AS s, [event_id] AS vals FROM r), b AS (SELECT vals[1] AS event_id, substr(s.tag, 2) AS event_type FROM n)
SELECT (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM r)) AS extra"""
)
def nested_roundtrip(spark, sf):
    """Rows put into structs and arrays and taken out again are the same rows."""
    rows = table(spark, sf, "events").select("event_id", "event_type")
    nested = rows.select(F.struct("event_id", F.concat(F.lit("t"), "event_type").alias("tag")).alias("s"), F.array("event_id").alias("vals"))
    return V.equal_tables(rows, nested.select(F.col("vals")[0].alias("event_id"), F.substring("s.tag", 2, 1000).alias("event_type")))


@query("SELECT user_id, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, count(*) AS n FROM events GROUP BY ALL")
def commit_rate_by_day(spark, sf):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").groupBy("user_id", F.unix_seconds(F.date_trunc("day", at)).alias("day")).agg(F.count("*").alias("n"))


# Smaller rules


@query("SELECT event_type, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(event_type, ''), lambda c: ord(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::VARCHAR AS hash FROM (SELECT DISTINCT event_type FROM events)")
def checksum_fnv64(spark, sf):
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", S.fnv1a_64(F.col("event_type")).cast("string").alias("hash"))


@query("SELECT event_id, to_base64(encode(event_type || event_id)) AS encoded FROM events")
def base64_text(spark, sf):
    return table(spark, sf, "events").select("event_id", F.base64(F.concat("event_type", "event_id").cast("binary")).alias("encoded"))


@query("SELECT event_id, user_id::VARCHAR AS a, event_type AS b, CASE WHEN event_id % 2 = 0 THEN 'x=y' END AS c FROM events")
def query_string_params(spark, sf):
    """A repeated name gives its first value, and a value may hold the sign."""
    q = F.concat(F.lit("a="), "user_id", F.lit("&b="), "event_type", F.lit("&a=0"), F.when(F.col("event_id") % 2 == 0, "&c=x=y").otherwise(""))
    return table(spark, sf, "events").select("event_id", *(S.first_parameter(q, n).alias(n) for n in "abc"))


@query("SELECT l_orderkey, 64 + 24 * count(*) + 4 * count(DISTINCT l_partkey) + 16 * count(*) FILTER (WHERE l_returnflag = 'N') AS length, greatest(0, (count(*) * 50 - 64) // 28) AS segments FROM lineitem GROUP BY 1")
def manifest_sizes(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunks"), F.countDistinct("l_partkey").alias("batches"), F.count_if(F.col("l_returnflag") == "N").alias("kept"))
    return per.select("l_orderkey", S.manifest_length(F.col("chunks"), F.col("batches"), F.col("kept")).alias("length"), S.segments_per_manifest(F.col("chunks") * 50).alias("segments"))


@query(f"SELECT version, sum(count(*)) OVER (ORDER BY version)::BIGINT AS rows_to, sum(sum(event_id)) OVER (ORDER BY version)::BIGINT AS sum_to FROM {LOG} GROUP BY version")
def total_batches_running(spark, sf):
    return V.running_totals(log(spark, sf), "event_id")


@query("WITH h AS (SELECT event_type, count(*) AS head FROM events GROUP BY 1) SELECT event_type, user_id, CASE WHEN max(event_id) % 3 = 0 THEN head ELSE least(min(event_id), head) END AS cursor FROM events JOIN h USING (event_type) GROUP BY event_type, user_id, head")
def topic_resume(spark, sf):
    """A subscriber starts at the head, or where it asks, but not beyond the head."""
    e = table(spark, sf, "events").select("event_type", "user_id", "event_id")
    asked = e.groupBy("event_type", "user_id").agg(F.min("event_id").alias("wanted"), (F.max("event_id") % 3 == 0).alias("live"))
    heads = e.groupBy("event_type").agg(F.count("*").alias("head"))
    return asked.join(heads, "event_type").select("event_type", "user_id", F.when(F.col("live"), F.col("head")).otherwise(F.least("wanted", "head")).alias("cursor"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'dropped' ELSE 'released' END AS binding FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 5 = o_orderkey % 5")
def binding_release(spark, sf):
    """Released when key and incarnation both match, else dropped."""
    live = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("incarnation"))
    refs = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 5).alias("incarnation"))
    joined = refs.join(live.withColumn("_live", F.lit(True)), ["c_custkey", "incarnation"], "left")
    return joined.select("o_orderkey", F.when(F.col("_live"), "released").otherwise("dropped").alias("binding"))


@query("SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS quiet FROM customer GROUP BY 1")
def quiescent_keys(spark, sf):
    """Keys with nothing open may be reclaimed."""
    open_ = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_open", F.lit(True))
    keys = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(open_, "c_custkey", "left")
    return keys.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("_open").isNull()).alias("quiet"))


@query("SELECT a.conv_id, a.turn, b.role AS reply_role, CASE WHEN b.turn IS NULL THEN 'orphan' WHEN length(b.text) > 400 THEN 'ReplyTooLarge' ELSE 'replied' END AS status FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def ask_replies(spark, sf):
    """Asks beside their replies by correlation; asks without one are swept, and replies over the limit fail."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply_role"), F.col("n").alias("reply_n"))
    status = F.when(F.col("reply_role").isNull(), "orphan").when(F.col("reply_n") > 400, "ReplyTooLarge").otherwise("replied")
    return turns.where("role = 'user'").join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_role", status.alias("status"))


@query("SELECT conv_id, turn, CASE WHEN strlen(text) > 192 THEN 'BodyTooLarge' ELSE 'echoed' END AS status, CASE WHEN strlen(text) <= 192 THEN text END AS body FROM conversations")
def actor_echo(spark, sf):
    fits = F.octet_length("text") <= 192
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(fits, "echoed").otherwise("BodyTooLarge").alias("status"), F.when(fits, F.col("text")).alias("body"))


@query("SELECT source, count(*) AS segments, sum(strlen(text))::BIGINT AS length FROM documents GROUP BY 1")
def object_length(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("segments"), F.sum(F.octet_length("text")).alias("length"))


@query("SELECT w AS worker, k AS step, (w % 8 + k * (2 * (w % 4) + 1)) % 8 AS shard FROM range(16) a(w), range(8) b(k)")
def steal_order(spark, sf):
    """From its home on, with an odd stride, a worker visits each of eight shards once."""
    workers = spark.range(16).select(F.col("id").alias("worker"), F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<long>")).alias("step"))
    return workers.withColumn("shard", (F.col("worker") % 8 + F.col("step") * (2 * (F.col("worker") % 4) + 1)) % 8)


@query("SELECT k AS i, 64 * (1 << k) AS class FROM range(9) t(k)")
def pool_classes(spark, sf):
    return spark.range(9).select(F.col("id").alias("i"), (F.pow(F.lit(2.0), F.col("id")) * 64).cast("long").alias("class"))


@query("SELECT user_id, sum(CASE WHEN event_id % 3 = 2 THEN -1 ELSE 1 END)::BIGINT AS outstanding, count(*) FILTER (WHERE event_type = 'error') > 0 AS failed FROM events GROUP BY 1")
def quota_outstanding(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 3 == 2, -1).otherwise(1)).alias("outstanding"), (F.count_if(F.col("event_type") == "error") > 0).alias("failed"))


@query("SELECT user_id, event_id, next_id - event_id AS until_reply FROM (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events) WHERE event_type = 'click' AND next_id IS NOT NULL")
def crash_outcome(spark, sf):
    """From a holder's end to its successor's first sign."""
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type").withColumn("_next", following)
    return rows.where("event_type = 'click' AND _next IS NOT NULL").select("user_id", "event_id", (F.col("_next") - F.col("event_id")).alias("until_reply"))


@query(f"SELECT head, since, count(*) FILTER (WHERE v <= since) AS skipped FROM (SELECT head, since, unnest(range(head - {K}, head)) AS v FROM (SELECT h * {K} + 1 AS head FROM range(1, 9) t(h)), (SELECT s AS since FROM range(0, 80, 5) u(s))) GROUP BY ALL")
def kept_skip_count(spark, sf):
    """How many of the batches that a Window commit keeps a reader already holds."""
    roots = spark.range(1, 9).select((F.col("id") * K + 1).alias("head"), F.explode(F.sequence(F.lit(0), F.lit(75), F.lit(5)).cast("array<long>")).alias("since"))
    kept = F.sequence(F.col("head") - K, F.col("head") - 1)
    return roots.select("head", "since", F.size(F.filter(kept, lambda v: v <= F.col("since"))).cast("long").alias("skipped"))


from tidelog.plans import histories, keys  # noqa: E402, F401  they register queries of their own
