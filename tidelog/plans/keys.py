"""Queries over keys: what is pinned, bound, reserved, staged and swept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import tasks as TK
from tidelog.operators import versions as V
from tidelog.plans.queries import LOG, log, query
from tidelog.sources.tables import table

PINS = [0, 1, 7, 20, 60, 1_000_000]


@query(
    f"""WITH p AS (SELECT unnest({PINS}) AS pinned), h AS (SELECT max(version) AS head FROM {LOG}) SELECT pinned::BIGINT AS pinned, CASE WHEN pinned = 0 OR pinned > head THEN 'NotFound' WHEN pinned % 10 = 0 THEN 'VersionGone' ELSE 'OK' END AS status,
count(l.event_id) AS n, coalesce(sum(l.event_id), 0)::BIGINT AS total FROM p CROSS JOIN h LEFT JOIN {LOG} l ON l.version <= pinned AND pinned % 10 != 0 AND pinned <= head GROUP BY pinned, head"""
)
def pinned_sums(spark, sf):
    """What readers derive from the versions that they pin; every tenth version has been evicted."""
    rows = log(spark, sf).select("event_id", "version")
    head = rows.agg(F.max("version").alias("head"))
    pins = spark.createDataFrame([(p,) for p in PINS], "pinned long").crossJoin(F.broadcast(head))  # one row
    status = F.when((F.col("pinned") == 0) | (F.col("pinned") > F.col("head")), "NotFound").when(F.col("pinned") % 10 == 0, "VersionGone").otherwise("OK")
    named = pins.withColumn("status", status)
    totals = V.running_totals(rows, "event_id").withColumnRenamed("version", "pinned")
    found = named.join(totals, "pinned", "left")
    ok = F.col("status") == "OK"
    return found.select("pinned", "status", F.when(ok, F.col("rows_to")).otherwise(0).alias("n"), F.when(ok, F.col("sum_to")).otherwise(0).alias("total"))


@query("WITH d AS (SELECT event_id, event_id * 2 + (event_id % 97 = 5)::BIGINT AS v FROM events WHERE event_id % 101 != 7) SELECT count(*) AS rows, count(d.event_id) AS done, count(*) FILTER (WHERE d.v = e.event_id * 2) AS right_ones, count(*) FILTER (WHERE d.v != e.event_id * 2) AS wrong_ones FROM events e LEFT JOIN d USING (event_id)")
def doubled_verified(spark, sf):
    """A worker's output beside its input: what is there, and what is right."""
    events = table(spark, sf, "events").select("event_id")
    output = events.where("event_id % 101 != 7").select("event_id", (F.col("event_id") * 2 + (F.col("event_id") % 97 == 5).cast("long")).alias("v"))
    both = events.join(output, "event_id", "left")
    want = F.col("event_id") * 2
    return both.agg(F.count("*").alias("rows"), F.count("v").alias("done"), F.count_if(F.col("v") == want).alias("right_ones"), F.count_if(F.col("v") != want).alias("wrong_ones"))


@query(
    """WITH k AS (SELECT c_custkey, c_nationkey, c_acctbal < 0 AS dead FROM customer), o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS pinned, count(*) FILTER (WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P') AS leased FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN NOT dead THEN 'live' WHEN coalesce(pinned, 0) > 0 THEN 'pinned' WHEN coalesce(leased, 0) > 0 THEN 'leased' ELSE 'swept' END AS fate FROM k LEFT JOIN o ON o_custkey = c_custkey"""
)
def tombstones_swept(spark, sf):
    """Keys that are gone are swept once no reader pins them and no writer holds a lease."""
    use = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("pinned"), F.count_if(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "P")).alias("leased"))
    keys = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("dead")).join(use, "c_custkey", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return keys.select("c_custkey", F.when(~F.col("dead"), "live").when(some("pinned"), "pinned").when(some("leased"), "leased").otherwise("swept").alias("fate"))


@query(
    """WITH l AS (SELECT list({'o': 0::BIGINT, 'g': 0::BIGINT, 'r': 0::BIGINT, 'd': CASE WHEN event_id % 5 >= 3 THEN -1 ELSE 1 END} ORDER BY event_id) AS log FROM events),
f AS (SELECT list_reduce(list_prepend({'o': 0::BIGINT, 'g': 0::BIGINT, 'r': 0::BIGINT, 'd': 0}, log), lambda a, b: {'o': CASE WHEN b.d > 0 AND a.o < 100 THEN a.o + 1 WHEN b.d < 0 AND a.o > 0 THEN a.o - 1 ELSE a.o END,
'g': a.g + (b.d > 0 AND a.o < 100)::BIGINT, 'r': a.r + (b.d > 0 AND a.o >= 100)::BIGINT, 'd': 0}) AS e FROM l) SELECT e.g AS granted, e.r AS refused, e.o AS outstanding FROM f"""
)
def reservation_total(spark, sf):
    """Reservations of all holders together, under one limit; ranges of the log are folded apart."""
    changes = table(spark, sf, "events").select(F.lit("all").alias("holder"), "event_id", F.when(F.col("event_id") % 5 >= 3, -1).otherwise(1).alias("change"))
    return TK.admitted(changes, "holder", "event_id", "change", 100).drop("holder")


@query(
    """WITH s AS (SELECT user_id, event_id // 500 AS txn, event_id, event_type FROM events), t AS (SELECT user_id, txn, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'error')) AS last FROM s GROUP BY ALL)
SELECT user_id, txn, CASE WHEN last IS NULL THEN 'open' WHEN last = 'error' THEN 'aborted' ELSE 'committed' END AS status, count(*) AS staged, CASE WHEN last = 'purchase' THEN count(*) ELSE 0 END AS visible FROM s JOIN t USING (user_id, txn) GROUP BY user_id, txn, last"""
)
def stream_txn_ends(spark, sf):
    """Transactions commit or abort; of those that abort or stay open, no batch is seen."""
    staged = table(spark, sf, "events").select("user_id", F.expr("event_id div 500").alias("txn"), "event_id", "event_type")
    end = F.max_by("event_type", F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id")))
    per = staged.groupBy("user_id", "txn").agg(F.count("*").alias("staged"), end.alias("_end"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("_ends"))
    status = F.when(F.col("_ends") == 0, "open").when(F.col("_end") == "error", "aborted").otherwise("committed")
    named = per.select("user_id", "txn", status.alias("status"), "staged")
    return named.withColumn("visible", F.when(F.col("status") == "committed", F.col("staged")).otherwise(0))


@query(
    """WITH s AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) AS id FROM events GROUP BY 1), a AS (SELECT event_id % 7 + 1 AS id, count(*) AS asks FROM events GROUP BY 1)
SELECT a.id, event_type, asks, event_type IS NOT NULL AS known FROM a LEFT JOIN s USING (id)"""
)
def schema_lookup(spark, sf):
    """Ids resolve to what was interned under them; nothing is interned by asking."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    asks = events.groupBy((F.col("event_id") % 7 + 1).alias("id")).agg(F.count("*").alias("asks"))
    return asks.join(V.interned(events, "event_type", "event_id").drop("first_seen"), "id", "left").select("id", "event_type", "asks", F.col("event_type").isNotNull().alias("known"))


@query(
    """WITH w AS (SELECT l_orderkey, count(*) AS outputs, count(*) FILTER (WHERE l_returnflag = 'A') AS acked FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(outputs, 0) AS outputs, CASE WHEN outputs IS NULL THEN 'unbound' WHEN o_orderstatus = 'O' THEN 'held' WHEN acked > 0 THEN 'released' ELSE 'kept' END AS state FROM orders LEFT JOIN w ON l_orderkey = o_orderkey"""
)
def task_outputs_bound(spark, sf):
    """Outputs are bound to their task: held while it runs, kept when it has ended, released by the first acknowledgement."""
    outputs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("outputs"), F.count_if(F.col("l_returnflag") == "A").alias("acked"))
    tasks = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(outputs, "o_orderkey", "left")
    state = F.when(F.col("outputs").isNull(), "unbound").when(F.col("o_orderstatus") == "O", "held").when(F.col("acked") > 0, "released").otherwise("kept")
    return tasks.select("o_orderkey", F.coalesce("outputs", F.lit(0)).alias("outputs"), state.alias("state"))


@query("SELECT source, arg_max(doc_id, doc_id) AS doc_id, md5(arg_max(text, doc_id)) AS digest, length(arg_max(text, doc_id)) AS size, count(*) AS version FROM documents GROUP BY source")
def object_read(spark, sf):
    """The bytes of each key's current version."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    versions = docs.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("version"))
    current = docs.join(versions, ["source", "doc_id"])
    return current.select("source", "doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("size"), "version")


@query("SELECT page_id, i AS segment, least(4096, length(html) - i * 4096) AS size, (i + 1) * 4096 >= length(html) AS last FROM (SELECT page_id, html, unnest(range(0, greatest(1, (length(html) + 4095) // 4096))) AS i FROM pages)")
def object_stream(spark, sf):
    """An object written piece by piece: every piece but the last is full, and the last one ends it."""
    pages = table(spark, sf, "pages").select("page_id", F.length("html").cast("long").alias("n"))
    pieces = pages.select("page_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / 4096), F.lit(1)) - 1)).alias("segment"))
    return pieces.select("page_id", "segment", F.least(F.lit(4096), F.col("n") - F.col("segment") * 4096).alias("size"), ((F.col("segment") + 1) * 4096 >= F.col("n")).alias("last"))
