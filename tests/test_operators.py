import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalars as S
from tidelog.operators import actors, folds, tasks, topics, versions


def window_log(head, width):
    """The batches that head holds under the windowed policy, and the base, by walking the commits."""
    held, depth = [], 0
    for v in range(1, head + 1):
        if v == 1 or depth + 1 < width:
            held, depth = held + [v], depth + 1 if v > 1 else 0
        else:
            held, depth = held[-width:] + [v], 0
    return held


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8])
def test_window_holds_the_newest_batches(spark, width):
    heads = spark.range(1, 6 * width + 6).select(F.col("id").alias("head"))
    got = {r["head"]: r["oldest"] for r in heads.withColumn("oldest", versions.window_oldest(F.col("head"), width)).collect()}
    assert got == {v: window_log(v, width)[0] for v in got}


def test_window_readers(spark):
    readers = spark.range(0, 20).select(F.col("id").alias("since"), F.lit(19).cast("long").alias("head"))
    got = {r["since"]: (r["t"], r["first"]) for r in readers.select("since", versions.window_truncated(F.col("since"), F.col("head"), 4).alias("t"), versions.window_first_read(F.col("since"), F.col("head"), 4).alias("first")).collect()}
    # head 19, width 4: the last Window commit is 17, it holds 13 to 16 and its base is 12
    assert got[0] == (False, 13) and got[11] == (True, 13) and got[12] == (False, 13) and got[15] == (False, 16) and got[17] == (False, 18) and got[19] == (False, 20)


def test_latest_per_key_takes_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 5, "c"), (2, 7, "d")], "k int, o int, v string")
    assert {tuple(r) for r in versions.latest_per_key(rows, "k", ["o"]).select("k", "o", "v").collect()} == {(1, 2, None), (None, 5, "c"), (2, 7, "d")}
    assert versions.latest_per_key(rows.limit(0), "k", ["o"]).count() == 0


def test_budget_delivers_the_message_that_crosses(spark):
    rows = spark.createDataFrame([("t", k, "x" * n) for k, n in enumerate([10, 100, 5, 5], 1)], "topic string, seq long, body string")
    assert sorted(r["seq"] for r in topics.within_budget(rows, "topic", F.length("body"), 50, 10).collect()) == [1, 2]
    assert sorted(r["seq"] for r in topics.within_budget(rows, "topic", F.length("body"), 1000, 3).collect()) == [1, 2, 3]


def test_ranges_come_back(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 9, 10)], "g string, n long")
    runs = topics.coalesced_ranges(rows, ["g"], "n")
    assert sorted((r["first"], r["n"]) for r in runs.collect()) == [(1, 3), (7, 1), (9, 2)]
    assert sorted(r["x"] for r in topics.expanded_ranges(runs, "first", "n", "x").collect()) == [1, 2, 3, 7, 9, 10]


def test_task_states(spark):
    logs = {1: ["claim", "complete", "fail"], 2: ["claim", "lapse", "claim", "fail"], 3: ["cancel", "claim"], 4: ["complete"], 5: ["claim", "cancel"]}
    rows = spark.createDataFrame([(t, k, e) for t, es in logs.items() for k, e in enumerate(es)], "task int, o int, what string")
    assert {r["task"]: r["state"] for r in tasks.folded(rows, "task", "o", "what").collect()} == {1: "DONE", 2: "FAILED", 3: "CANCELLED", 4: "QUEUED", 5: "CLAIMED"}


def test_reaping_allows_retries(spark):
    rows = spark.createDataFrame([(n,) for n in range(6)], "lapses int")
    assert [(r["attempts"], r["outcome"]) for r in tasks.reaped(rows, "lapses").orderBy("lapses").collect()] == [(1, "DONE"), (2, "DONE"), (3, "DONE"), (4, "DONE"), (4, "FAILED"), (4, "FAILED")]


def test_refused_requests_take_nothing(spark):
    rows = spark.createDataFrame([("h", k, c) for k, c in enumerate([1, 1, 1, -1, 1, 1])], "h string, o int, change int")
    r = tasks.admitted(rows, "h", "o", "change", 2).first()
    assert (r["granted"], r["refused"], r["outstanding"]) == (3, 2, 2)


def rows_at_once(frame):
    """Whether the rows of a key are gathered as they are."""
    plan = frame._jdf.queryExecution().analyzed().toString()
    return "collect_list" in plan and "MapInArrow" not in plan


def test_folds_of_one_long_key_lie_in_many_tasks(spark):
    import random

    rnd = random.Random(4)
    changes = [rnd.choice([1, 1, 1, -1, -1, None]) for _ in range(4000)]
    sizes = [rnd.choice([0, 1, 64, 65, 300, 700, 1000, 1001, 1100]) for _ in range(4000)]
    out = granted = refused = 0
    for c in changes:
        if c == 1:
            out, granted, refused = (out + 1, granted + 1, refused) if out < 5 else (out, granted, refused + 1)
        elif c == -1:
            out = max(out - 1, 0)
    used = chunks = big = 0
    for n in sizes:
        need = -(-n // 64) * 64
        if n > 1000:
            big += 1
        elif chunks and used + need <= 1000:
            used += need
        else:
            used, chunks = need, chunks + 1
    rows = spark.createDataFrame([("one", k, c, n) for k, (c, n) in enumerate(zip(changes, sizes))] + [(None, 1, 1, 1001), ("two", 1, -1, None)], "g string, o int, change int, size long").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        taken, packed = tasks.admitted(rows, "g", "o", "change", 5), tasks.packed_buffers(rows, "g", "o", "size", 1000)
        assert {tuple(r) for r in taken.collect()} == {("one", granted, refused, out), (None, 1, 0, 1), ("two", 0, 0, 0)}
        assert {tuple(r) for r in packed.collect()} == {("one", chunks, used, big), (None, 0, 0, 1), ("two", 0, 0, 0)}
        assert not rows_at_once(taken) and not rows_at_once(packed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_hash_vectors(spark):
    rows = spark.createDataFrame([("pricer", 343484808), ("risk", 4079720170), ("echo", 3567113348), ("", 2166136261)], "s string, want long")
    assert rows.where(S.fnv1a_32(F.col("s")) != F.col("want")).count() == 0


def test_names(spark):
    rows = spark.createDataFrame([("ok.name_1-", True), ("", False), ("a" * 33, False), ("a/b", False), ("a\n", False)], "s string, want boolean")
    assert rows.where(S.is_topic_name(F.col("s")) != F.col("want")).count() == 0


def test_curve_is_flat_outside_and_linear_within(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (1.0, 1.0), (1.5, 1.5), (2.0, 2.0), (9.0, 2.0)], "t double, want double")
    curve = F.expr("array(named_struct('tenor', 1.0D, 'rate', 1.0D), named_struct('tenor', 2.0D, 'rate', 2.0D))")
    assert rows.where(F.abs(S.interpolated(curve, F.col("t")) - F.col("want")) > 1e-12).count() == 0


COMMITS = [(1, "Replace", 0), (2, "Append", 0), (3, "Append", 0), (4, "Window", 2), (5, "Append", 0), (6, "Window", 1), (7, "Window", 3), (8, "Replace", 0), (9, "Window", 5)]
#: head: {since: (rows, from_version, truncated)}
READS = {
    3: {0: ([1, 2, 3], 1, False), 1: ([2, 3], 2, False), 2: ([3], 3, False), 3: ([], 3, False), 7: ([], None, False)},
    4: {0: ([2, 3, 4], None, False), 1: ([2, 3, 4], 4, False), 2: ([3, 4], 4, False), 3: ([4], 4, False), 4: ([], None, False)},
    5: {3: ([4, 5], 4, False), 4: ([5], 5, False)},
    6: {3: ([5, 6], 6, True), 4: ([5, 6], 6, False)},
    7: {4: ([5, 6, 7], None, False), 5: ([6, 7], None, False), 6: ([7], None, False)},
    8: {7: ([8], 8, True)},
    9: {7: ([8, 9], None, True), 8: ([9], None, False)},
}


def test_deltas_over_commits_of_all_kinds(spark):
    states = versions.commit_states(spark.createDataFrame(COMMITS, "version long, kind string, keep int"), [])
    held = {r["version"]: (r["low"], r["base"]) for r in states.collect()}
    assert [held[v][1] for v in (4, 6, 7, 9)] == [1, 4, 4, 8]
    assert [held[v][0] for v in (4, 6, 7, 9)] == [2, 5, 5, 8]
    readers = spark.createDataFrame([(s, h) for h, reads in READS.items() for s in reads], "since long, head long")
    got = {(r["head"], r["since"]): (list(range(r["first"], r["head"] + 1)), r["from_version"], r["truncated"]) for r in versions.mixed_reads(states, readers, []).collect()}
    for head, reads in READS.items():
        for since, (rows, begun, lost) in reads.items():
            found = got[head, since]
            assert found[0] == rows and found[2] == lost and begun in (None, found[1])


def test_running_sums_cross_buckets(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), k, rnd.choice([None, 1, 2, 5])) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, o int, id int, n int")
    got = {r["id"]: (r["s"], r["m"]) for r in folds.running(frame, ["g"], "o", {"s": F.col("n")}, ("id",), {"m": F.col("n")}, bucket_rows=7).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in ("a", "b", None):
        total, most = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=key):
            total, most = total + (r[3] or 0), max([x for x in (most, r[3]) if x is not None], default=None)
            assert got[r[2]] == (total, most)
    assert folds.running(frame.limit(0), ["g"], "o", {"s": F.col("n")}).count() == 0
    one = spark.createDataFrame([("a", 5, 1), ("a", 5, 2)], "g string, o int, id int")
    assert sorted(r["k"] for r in folds.numbered(one, [], "o", "k", ("id",)).collect()) == [1, 2]


def test_no_task_orders_a_whole_topic(spark):
    frame = spark.range(4000).select(F.lit("one").alias("topic"), F.col("id"))
    plan = folds.running(frame, ["topic"], "id", {"seq": F.lit(1)}, bucket_rows=100)
    windows = [line for line in plan._jdf.queryExecution().analyzed().toString().splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("_bucket" in line for line in windows)
    assert plan.agg(F.max("seq"), F.countDistinct("seq")).first() == (4000, 4000)


def test_shares_by_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [5, 1, 1, 1, 9]] + [("b", 2.0), ("b", None), (None, 3.0)], "g string, v double")
    got = {r["g"]: (r["half"], r["all"]) for r in folds.at_share(rows, ["g"], "v", {"half": 0.5, "all": 1.0}).collect()}
    assert got == {"a": (1.0, 9.0), "b": (2.0, 2.0), None: (3.0, 3.0)}


def test_ranks_of_cut_and_whole_groups(spark):
    import random

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None, *(f"s{k}" for k in range(40))][: rnd.choice([3, 43])]), rnd.choice([None, *(k / 4 for k in range(60))])) for _ in range(900)]
    rows += [("null", None), ("one", 1.0), ("one", None), ("big", -1e308), ("big", 1e308)] + [("same", 7.0)] * 30 + [("nan", v) for v in [float("nan"), 1.0, 2.0] * 9]
    frame = spark.createDataFrame(rows, "g string, v double")
    ranks = {"half": lambda n, values: F.floor(n / 2) + 1, "top": lambda n, values: values, "none": lambda n, values: n + 1}
    shares = {"p10": 0.1, "p99": 0.99}
    for size in (1, 7, 20, 10_000):
        got = {r["g"]: (r["half"], r["top"], r["none"]) for r in folds.at_ranks(frame, ["g"], "v", ranks, size).collect()}
        part = {r["g"]: (r["p10"], r["p99"]) for r in folds.at_share(frame, ["g"], "v", shares, size).collect()}
        assert len(got) == len(part) == len({g for g, _ in rows})
        for g in got:
            own = [v for k, v in rows if k == g]
            values = sorted((v for v in own if v is not None), key=lambda v: (v != v, v))
            at = lambda k: values[k - 1] if 1 <= k <= len(values) else None
            want = (at(len(own) // 2 + 1), at(len(values)), None, *(at(max(len(values) - int(len(values) - len(values) * q), 1)) for q in shares.values()))
            assert str((*got[g], *part[g])) == str(want), (size, g)


def test_no_task_orders_a_whole_group_for_its_ranks(spark):
    frame = spark.range(4000).select(F.when(F.col("id") < 3900, "one").otherwise(F.col("id").cast("string")).alias("g"), "id")
    found = folds.at_ranks(frame, ["g"], "id", {"half": lambda n, values: F.floor(n / 2)}, bucket_rows=100)
    windows = [line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and all("_bucket" in line for line in windows)
    assert {r["g"]: r["half"] for r in found.collect()}["one"] == 1949


def test_compare_and_set_names_versions(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 5), ("b", 1, 1), ("b", 2, 0)], "k string, o int, expect long")
    got = sorted(tuple(r) for r in versions.put_if(rows, "k", ["o"], "expect", ["k", "o"]).collect())
    assert got == [("a", 1, "created", 1), ("a", 2, "VersionMismatch", 1), ("a", 3, "installed", 2), ("a", 4, "VersionMismatch", 2), ("b", 1, "VersionMismatch", 0), ("b", 2, "created", 1)]


def test_frames_and_lines(spark):
    rows = spark.createDataFrame([(1, "e", bytearray(b"one\ntwo")), (2, "", bytearray(b"")), (3, "e", bytearray(b"\xff\x00")), (4, None, bytearray(b'q"\\\t\x02'))], "seq long, event string, data binary")
    f = {r["seq"]: r["f"] for r in rows.select("seq", topics.sse_frame(F.col("seq"), F.col("event"), F.col("data")).alias("f")).collect()}
    assert f == {1: "id: 1\nevent: e\ndata: one\ndata: two\n\n", 2: "id: 2\ndata: \n\n", 3: "id: 3\nevent: e\n:b64\ndata: /wA=\n\n", 4: 'id: 4\ndata: q"\\\t\x02\n\n'}
    line = topics.json_line(F.col("seq"), F.lit(7), F.coalesce("event", F.lit("")), F.lit("text/plain"), F.col("data"))
    found = {r["seq"]: r["f"] for r in rows.select("seq", line.alias("f")).collect()}
    assert found[4] == '{"seq":4,"ts_ms":7,"event":"","content_type":"text/plain","data":"q\\"\\\\\\t\\u0002"}\n'
    assert found[3] == '{"seq":3,"ts_ms":7,"event":"e","content_type":"text/plain","data_b64":"/wA="}\n'


def test_maps_and_variants_are_refused_at_any_depth(spark):
    schema = spark.sql("SELECT 1 AS a, map(1, 2) AS b, array(named_struct('x', map(1, 2))) AS c, array(1) AS d, parse_json('1') AS e, named_struct('y', array('z')) AS f").schema
    assert [S.admitted_type(c.dataType) for c in schema] == [True, False, False, True, False, True]


def test_handlers_tell_one_another(spark):
    def first(state, at, kind, body):
        return (state[0] + 1,), [("tell", "second", f"{body}{state[0]}")]

    def second(state, at, kind, body):
        return (state[0] + body,), [("publish", "t", state[0] + body), ("tell", "third", "x")] if len(state[0]) < 3 else []

    handlers = {"first": actors.Handler((0,), first), "second": actors.Handler(("",), second, accepts=("tell",))}
    rows = spark.createDataFrame([("first", 1, 1, "m", "a"), ("first", 1, 2, "m", "b"), ("first", 2, 1, "m", "c"), ("second", 1, 9, "m", "no"), ("fourth", 1, 1, "m", "d")], "actor string, key long, at long, kind string, body string")
    got = sorted((r["actor"], r["key"], r["at"], r["effect"], r["target"] or "", r["body"]) for r in actors.host(rows, handlers).collect())
    assert [g for g in got if g[3] == "publish"] == [("second", 1, 1, "publish", "t", "a0"), ("second", 1, 2, "publish", "t", "a0b1"), ("second", 2, 1, "publish", "t", "c0")]
    assert {g[0] for g in got if g[3] == "unknown"} == {"third", "fourth"} and [g[:3] for g in got if g[3] == "refused"] == [("second", 1, 9)]
