"""Topics, rings and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.folds import numbered


def sequenced(messages: DataFrame, topic: str, order: str) -> DataFrame:
    """messages with seq: their number in their topic, by a number that orders them."""
    return numbered(messages, [topic], order, "seq")


def ring_read(cursor: Column, head: Column, capacity: int) -> tuple[Column, Column, Column]:
    """(status, skipped, new_cursor) of a non-blocking read."""
    lapped = head - cursor > capacity
    status = F.when(cursor >= head, "empty").when(lapped, "lagged").otherwise("sample")
    return status, F.when(lapped & (cursor < head), head - capacity - cursor).otherwise(0).cast("long"), F.when(cursor >= head, cursor).when(lapped, head - capacity).otherwise(cursor + 1).cast("long")


def read_since(kept: DataFrame, cursors: DataFrame, topic: str) -> DataFrame:
    """Per (topic, cursor): from_seq, truncated, n_messages. kept: the messages still held, with seq."""
    edges = kept.groupBy(topic).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    lost = F.col("first") > F.col("cursor") + 1
    start = F.when(lost, F.col("first") - 1).otherwise(F.col("cursor"))
    return cursors.join(edges, topic).select(topic, "cursor", start.cast("long").alias("from_seq"), lost.alias("truncated"), F.greatest(F.col("last") - start, F.lit(0)).cast("long").alias("n_messages"))


def read_messages(kept: DataFrame, cursors: DataFrame, topic: str) -> DataFrame:
    """What readers get, a row for each message, and one for the gap of a reader who lags.

    kept: the messages still held, with seq. cursors: topic, reader, cursor. A message row has lost = 0;
    a lag row has the reader's cursor as seq and in lost how many messages are gone."""
    reads = read_since(kept, cursors, topic)
    reads = cursors.join(reads.select(topic, "cursor", "from_seq", "truncated").distinct(), [topic, "cursor"])
    columns = [c for c in kept.columns if c not in (topic, "seq")]
    sent = kept.join(reads, topic).where(F.col("seq") > F.col("from_seq"))
    lag = reads.where("truncated").select(topic, "reader", F.col("cursor").alias("seq"), *(F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in columns), (F.col("from_seq") - F.col("cursor")).alias("lost"))
    return sent.select(topic, "reader", "seq", *columns, F.lit(0).cast("long").alias("lost")).unionByName(lag)


def within_budget(messages: DataFrame, topic: str, size: Column, budget: int, most: int, after: int = 0) -> DataFrame:
    """What one long poll after a seq delivers: messages until the bytes before reach the budget, most at most. The message that crosses it is delivered.

    messages have their seq, so at most so many rows of a topic are ordered."""
    w = Window.partitionBy(topic).orderBy("seq")
    before = F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = messages.where((F.col("seq") > after) & (F.col("seq") <= after + most)).withColumn("_size", size)
    return sized.withColumn("_before", before).where(F.col("_before") < budget)


def sse_frame(seq: Column, event: Column, data: Column) -> Column:
    """A server-sent event: id, the event if it has a name, each line of the data as a field, an empty line. Bytes that are not UTF-8 are one line of base64 after a comment."""
    text = F.try_validate_utf8(data.cast("string"))
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))), "")
    body = F.when(text.isNotNull(), lines).otherwise(F.concat(F.lit(":b64\ndata: "), F.base64(data), F.lit("\n")))
    named = F.when(F.coalesce(event, F.lit("")) != "", F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\n"), named, body, F.lit("\n"))


def lag_frame(resume: Column, head: Column) -> Column:
    """What a reader is told who has lost messages."""
    return F.concat(F.lit('event: lagged\ndata: {"resume":'), resume.cast("string"), F.lit(',"head":'), head.cast("string"), F.lit("}\n\n"))


def json_text(text: Column) -> Column:
    """text as a JSON string: quotes and backslashes escaped, line feeds, returns and tabs by letter, other control characters by number."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {10: "\\n", 13: "\\r", 9: "\\t"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_line(seq: Column, ts_ms: Column, event: Column, content_type: Column, data: Column) -> Column:
    """A message as a line of JSON; bytes that are not UTF-8 stand under data_b64."""
    text = F.try_validate_utf8(data.cast("string"))
    body = F.when(text.isNotNull(), F.concat(F.lit('"data":'), json_text(text))).otherwise(F.concat(F.lit('"data_b64":"'), F.base64(data), F.lit('"')))
    return F.concat(F.lit('{"seq":'), seq.cast("string"), F.lit(',"ts_ms":'), ts_ms.cast("string"), F.lit(',"event":'), json_text(event), F.lit(',"content_type":'), json_text(content_type), F.lit(","), body, F.lit("}\n"))


def redelivered(received: DataFrame, subscriber: list[str]) -> DataFrame:
    """got, repeats, missing: deliveries of each subscriber, those that came again, and the numbers between first and last that never came."""
    each = received.groupBy(*subscriber, "seq").agg(F.count("*").alias("_times"))
    some = F.max("seq") - F.min("seq") + 1 - F.count("*")
    return each.groupBy(*subscriber).agg(F.sum("_times").alias("got"), F.sum(F.col("_times") - 1).alias("repeats"), some.alias("missing"))


def gaps(received: DataFrame, subscriber: list[str], order: str) -> DataFrame:
    """got, gaps: of each subscriber, the messages whose seq is not the one after the last."""
    last = F.lag("seq").over(Window.partitionBy(*subscriber).orderBy(order))
    marked = received.withColumn("_gap", F.coalesce(F.col("seq") != last + 1, F.lit(False)))
    return marked.groupBy(*subscriber).agg(F.count("*").alias("got"), F.sum(F.col("_gap").cast("long")).alias("gaps"))


def coalesced_ranges(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of successive numbers as (first, n)."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number))
    return rows.select(*group, number).distinct().withColumn("_island", island).groupBy(*group, "_island").agg(F.min(number).alias("first"), F.count("*").alias("n")).drop("_island")


def expanded_ranges(ranges: DataFrame, first: str, n: str, name: str) -> DataFrame:
    return ranges.where(F.col(n) > 0).withColumn(name, F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1)))
