"""Operator 7: secrets in texts.

Three fixed patterns give base spans. Values that stand in a credential context are then priced by the
number of guesses they withstand: the cheapest way to cut a value into known words, dates, repeats,
sequences, keyboard walks and spans that only brute force finds. Costly values become spans too.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import freeing, ids_of, table, with_ids

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth(?:orization)?|bearer)["']?[ \t]*(?:[:=]|\bis\b|->)[ \t]*["']?([^\s"'<>,;]{6,})""", re.I | re.A)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Words that guessers try first, most usual first.
COMMON = (
    "password pass admin root user login test guest welcome secret default master hello love dragon monkey letmein sunshine princess football "
    "baseball shadow superman batman iloveyou trustno freedom whatever hunter killer summer winter spring autumn january february march april "
    "may june july august september october november december monday tuesday wednesday thursday friday saturday sunday changeme example sample "
    "temp demo my the your this key token placeholder none null true false value string name "
    "michael jordan jennifer charlie thomas daniel robert jessica ashley nicole hannah andrew joshua matthew george maggie pepper ginger buster cookie cheese banana orange "
    "apple silver golden purple yellow diamond flower butterfly chocolate soccer hockey tigger thunder phoenix eagle falcon tiger computer internet server network "
    "system office manager service account access private public backup mobile online company business change update hidden safe lock open start stop new old first last "
    "red blue green black white one two three mother father sister brother family friend forever always happy lucky magic star moon water fire wind stone river"
).split()
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: log10 of the guesses from which a value is a secret.
STRONG = 9.0
_RANK = {w: k + 1 for k, w in enumerate(COMMON)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_PART = math.log10(2)
#: Price of a sequence's first character and direction; of a walk's start, and of each of its steps.
_SEQUENCE, _WALK, _STEP = math.log10(52), math.log10(40), math.log10(2.5)


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _alphabet(c: str) -> float:
    return 10.0 if c.isdigit() else 26.0 if c.isalpha() and c.isascii() else 33.0 if c.isascii() else 100.0


def length_cost(n: int) -> float:
    """log10 of the lengths that a guesser has tried by n, who tries them in ranges that double."""
    return (n - 1).bit_length() * _PART


class Run:
    """The places from which a run of like steps goes on; the cheapest start for any end, whatever the run's length.

    A range of lengths is a window of starts, whose least price stands at the head of a queue."""

    def __init__(self, least: int):
        self.least, self.begin, self.queues = least, 0, []

    def end(self, j: int, goes_on: bool, best: list[float]) -> float:
        """The least best[i] + length_cost(j - i) over runs from i to j of least steps or more; goes_on: the character before j belongs to the run before it."""
        if not goes_on:
            self.begin, self.queues = j - 1, []
        out, start = math.inf, j - self.least
        if start < self.begin:
            return out
        reach = max(1, (j - self.begin - 1).bit_length())
        while len(self.queues) < reach + 1:
            self.queues.append(deque(self.queues[-1] if self.queues else ()))
        for k, queue in enumerate(self.queues):
            while queue and best[queue[-1]] >= best[start]:
                queue.pop()
            queue.append(start)
            while queue and j - queue[0] > 1 << k:
                queue.popleft()
            if queue:
                out = min(out, best[queue[0]] + k * _PART)
        return out


def guess_cost(value: str, words: frozenset[str] = frozenset(), common: dict[str, int] = _RANK) -> float:
    """log10 of the guesses for value: the cheapest segmentation, by dynamic programming over its ends.

    words: further words that a guesser has from the text around; common: words by rank, most usual
    first. A segment may be any part of a run (repeat, sequence, keyboard walk), so all cuts are
    compared; a value of n characters takes about n log n steps. An empty value costs 0."""
    n, low = len(value), lowered(value)
    best = [0.0] + [math.inf] * n
    longest = max(max(map(len, common), default=0), max(map(len, words), default=0))
    repeat, up, down = Run(3), Run(3), Run(3)
    walk = math.inf  # the least best[i] - i * _STEP over the walk's starts so far
    walk_from = 0
    for j in range(1, n + 1):
        c, before = value[j - 1], value[j - 2] if j > 1 else ""
        size = math.log10(_alphabet(c))
        best[j] = min(best[j], best[j - 1] + size)  # brute force: one character at a time, without the price of a part
        step = ord(c) - ord(before) if before else 0
        cost = repeat.end(j, c == before, best) + size
        cost = min(cost, min(up.end(j, step == 1, best), down.end(j, step == -1, best)) + _SEQUENCE)
        if not before or not _near(low[j - 2], low[j - 1]):
            walk, walk_from = math.inf, j - 1
        if j - 4 >= walk_from:
            walk = min(walk, best[j - 4] - (j - 4) * _STEP)
            cost = min(cost, walk + j * _STEP + _WALK)
        best[j] = min(best[j], cost + _PART)
        # words and dates that begin here
        i, base = j - 1, best[j - 1] + _PART
        for k in range(i + 2, min(n, i + longest) + 1):
            word = low[i:k]
            rank = common.get(word) or (1000 if word in words else 0)
            if rank:
                best[k] = min(best[k], base + math.log10(rank + 1) + (0 if value[i:k] == word else math.log10(4)))
        if c.isdigit():
            for k in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, k):
                    best[k] = min(best[k], base + math.log10(40_000 if k - i > 4 else 120))
    return best[n]


def lowered(text: str) -> str:
    """text in lower case, as long as text: a letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_secrets(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 guesses) of all spans, by start, then kind. Starts and ends count code points.

    Null and empty texts have none. A priced value that lies wholly in a base span adds no span of its own; one that reaches out of it does, so spans may overlap."""
    if not text:
        return []
    low = lowered(text)
    spans: list[tuple[str, int, int, float]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end(), guess_cost(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), guess_cost(m[0])) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), guess_cost(m[0])) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        base, values = list(spans), [m.span(1) for m in _CONTEXT.finditer(text)]
        cuts = [0, *(x for span in values for x in span), len(text)]
        around = " ".join(low[a:b] for a, b in zip(cuts[::2], cuts[1::2]))  # what no value is part of
        words = frozenset(re.findall(r"[a-z]{3,24}", around)) if values else frozenset()
        for start, end in values:
            if any(a <= start and end <= b for _, a, b, _ in base):
                continue
            cost = guess_cost(text[start:end], words)
            if cost >= STRONG:
                spans.append(("guess", start, end, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, log10_guesses), for each row of docs.

    Null or empty text has no span; null doc_id and repeated rows stay; an empty table gives no row;
    other columns are ignored."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": ids_of(batch), "spans": [[{"kind": k, "start": a, "end": b, "log10_guesses": c} for k, a, b, c in find_secrets(t)] for t in batch["text"]]})

    return with_ids(docs, "text").mapInPandas(freeing(found), "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>")


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span's characters replaced by mark; all rows stay, n_chars is counted anew."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            spans = find_secrets(text)
            if not spans:
                return text
            out, at = [], 0
            for _, a, b, _ in spans:
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    clean = docs.withColumn("text", mask("text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(join(base), 256).alias("base_sha256"), join("spans").alias("spans"))
