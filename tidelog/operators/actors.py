"""User handlers with state, run over messages.

A handler sees the messages of one key of one actor, in order, with the state that it left, and gives
effects: replies, publications, objects to put, and messages to other actors, which are sent on until
there are none. A key's messages stream through one task; keys lie in many.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.folds import folded_rows

EFFECTS = "actor string, key long, at long, hop int, effects array<struct<effect:string,target:string,body:string>>"


@dataclass(frozen=True)
class Handler:
    """start: the first state; handle(state, at, kind, body) gives the next one and effects (effect, target, body).

    accepts: the kinds of message that it takes; none named: all."""

    start: tuple
    handle: Callable[[tuple, int, str, str], tuple[tuple, list]]
    accepts: tuple[str, ...] = ()


def host(messages: DataFrame, handlers: dict[str, Handler], most_hops: int = 8) -> DataFrame:
    """actor, key, at, effect, target, body: what handlers make of messages (actor, key, at, kind, body).

    A message for an actor that is not there has the effect unknown, one of a kind that its actor does
    not accept the effect refused. Messages that handlers tell are handled after those that were there,
    with the state that these left; after most_hops rounds of telling, what is still told stays as a row
    and is sent no further."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        actor, key, at, kind, body, hop, _ = row
        found = handlers.get(actor)
        refused = "unknown" if found is None else "refused" if found.accepts and kind not in found.accepts else None
        if refused:
            return state, (actor, key, at, hop, [{"effect": refused, "target": None, "body": body}])
        now, out = found.handle(state or found.start, at, kind, body)
        return now, (actor, key, at, hop, [{"effect": e, "target": t, "body": b} for e, t, b in out])

    def handled(all_sent: DataFrame) -> DataFrame:
        cells = all_sent.withColumn("_cell", F.concat_ws(":", "actor", F.col("key").cast("string")))
        each = folded_rows(cells, "_cell", ["hop", "at"], (), step, EFFECTS)
        return each.select("actor", "key", "at", "hop", F.explode("effects").alias("_e")).select("actor", "key", "at", "hop", "_e.*")

    sent = messages.select("actor", "key", "at", "kind", "body", F.lit(0).alias("hop"))
    out = handled(sent)
    for hop in range(1, most_hops + 1):
        told = out.where("effect = 'tell'")
        if not told.where(F.col("hop") == hop - 1).limit(1).count():
            break
        out = handled(sent.unionByName(told.select(F.col("target").alias("actor"), "key", "at", F.lit("tell").alias("kind"), "body", (F.col("hop") + 1).alias("hop"))))
    return out.drop("hop")
