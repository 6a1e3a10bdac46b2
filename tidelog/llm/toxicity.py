"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector, if it is a known word, beside the mean of its character n-grams'
vectors. The network reads windows of words in both directions; attention pools the states, and a
document's score is that of its highest window. Windows overlap by half and cover the whole text, so
any passage of up to WINDOW - STRIDE + 1 words lies whole in one. Of a run of letters without a break,
pieces of LONGEST_WORD characters that overlap count as words, so every n-gram of a text is read.
Forward and backward passes are numpy; the fit runs on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import free, freeing, ids_of, table, with_ids

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 8, 8, 12, 8
GRAM_BITS, GRAM_LENGTHS, LONGEST_WORD = 14, (3, 4, 5), 40
#: The fit's bounds: documents of either label, windows of a clean document, known words; passes, and the least steps.
FIT_TOXIC, FIT_CLEAN, FIT_WINDOWS, KNOWN_WORDS, EPOCHS, STEPS = 700, 2000, 4, 4000, 7, 300
#: Longer texts are left out of the fit's sample. All are scored whole.
FIT_CHARS = 100_000
THRESHOLD, SEED = 0.7, 7


def words_of(text: str | None) -> list[str]:
    """The text's words in lower case; a longer one than LONGEST_WORD in pieces, each beginning with the last characters of the one before."""
    words = WORD.findall(text.lower()) if text else []
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    step = LONGEST_WORD - max(GRAM_LENGTHS) + 1
    return [w[k : k + LONGEST_WORD] for w in words for k in range(0, max(1, len(w) - LONGEST_WORD + step), step)]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, word) index pairs of the words' character n-grams, with a mark before the first letter."""
    marked = ["\2" + w + "\3\0\0\0\0" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(m) for m in marked])
    code, valid = np.zeros(len(chars), np.uint32), np.ones(len(chars), bool)
    ids, owners = [], []
    for n in range(1, max(GRAM_LENGTHS) + 1):
        own = chars[n - 1 :]
        code = (code[: len(own)] + own + np.uint32(n)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        valid = valid[: len(own)] & (own != 0)
        if n in GRAM_LENGTHS:
            ids.append(((code[valid] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32))
            owners.append(owner[: len(own)][valid])
    return np.concatenate(ids), np.concatenate(owners)


def window_starts(n: int) -> list[int]:
    """Of all windows over n words; the last ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0] if n else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    known: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, known: dict[str, int], rng: np.random.Generator) -> "Network":
        h, d = HIDDEN, WORD_SIZE + CHAR_SIZE
        size = {"word": (len(known) + 1, WORD_SIZE), "gram": (1 << GRAM_BITS, CHAR_SIZE), "input": (d, 6 * h), "bias": (6 * h,), "forward": (h, 3 * h), "back": (h, 3 * h), "att": (2 * h, ATTENTION), "att_v": (ATTENTION,), "out": (2 * h,), "out_b": (1,)}
        p = {k: rng.normal(0, 0.1 if k in ("word", "gram") else 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in size.items()}
        p["bias"][:] = 0
        p["out_b"][:] = -2
        return cls(known, p)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' inputs, then what they came from: word rows, n-grams, their owners, n-grams a word."""
        rows = np.array([self.known.get(w, 0) for w in words], np.int64)
        gram, owner = word_grams(words)
        each = np.bincount(owner, minlength=len(words)).astype(np.float32)
        if not words:
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32), rows, gram, owner, each
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(each.astype(np.int64))
        sums = np.add.reduceat(self.p["gram"][gram[order]], np.concatenate([[0], ends[:-1]]))  # every word has an n-gram
        return np.concatenate([self.p["word"][rows], sums / np.sqrt(each)[:, None]], 1), rows, gram, owner, each

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """Each word's share of all gates, and a last row for places after the text."""
        u = vectors @ self.p["input"] + self.p["bias"]
        return np.concatenate([u, self.p["bias"][None, :]]).astype(np.float32)

    def read(self, u: np.ndarray, ids: np.ndarray, keep: bool = False):
        """States (windows, places, 2h); ids: rows of u. keep: also what the backward pass needs."""
        n, t = ids.shape
        h = HIDDEN
        states = np.empty((t, n, 2 * h), np.float32)
        kept = ([], [])
        for side, (name, order) in enumerate((("forward", range(t)), ("back", range(t - 1, -1, -1)))):
            own, r_ = u[:, 3 * h * side : 3 * h * (side + 1)], self.p[name]
            now = np.zeros((n, h), np.float32)
            own = np.ascontiguousarray(own)
            for k in order:
                a, g = own.take(ids[:, k], axis=0), now @ r_
                rz = sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
                if keep:
                    kept[side].append((k, now, r, z, new, g[:, 2 * h :]))
                now = new + z * (now - new)
                states[k, :, h * side : h * (side + 1)] = now
        return states, kept

    def logits(self, states: np.ndarray, mask: np.ndarray | None):
        """mask: False at places after the text; None: there are none."""
        s = np.tanh(states @ self.p["att"])
        e = s @ self.p["att_v"]  # places, windows
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        return pooled @ self.p["out"] + self.p["out_b"], s, alpha, pooled

    def windows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of many documents: the logit of each window, and its document."""
        number: dict[str, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
        starts = [window_starts(len(d)) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        out = np.zeros(len(owner), np.float32)
        if not len(owner):
            return out, owner
        pad = len(number)
        u = self.inputs(self.vectors(list(number))[0])
        ids = np.full((len(owner), WINDOW), pad, np.int64)
        k = 0
        for d, ss in zip(docs, starts):
            if len(d) >= WINDOW:
                ids[k : k + len(ss)] = np.lib.stride_tricks.sliding_window_view(d, WINDOW)[ss]
            elif len(d):
                ids[k, : len(d)] = d
            k += len(ss)
        short = ids[:, -1] == pad
        for rows, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for a in range(0, len(rows), 1024):
                part = ids[rows[a : a + 1024]]
                states, _ = self.read(u, part)
                out[rows[a : a + 1024]] = self.logits(states, part != pad if masked else None)[0]
        return out, owner

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; a text without words: 0."""
        logit, owner = self.windows([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit.astype(np.float64))
        return sigmoid(best)

    def step(self, ids: np.ndarray, vectors: tuple, y: np.ndarray, pad: int) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch of windows; ids: rows of vectors, pad after the text."""
        x, rows, gram, owner, each = vectors
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        u, mask = self.inputs(x), ids != pad
        states, kept = self.read(u, ids, keep=True)
        logit, s, alpha, pooled = self.logits(states, mask)
        prob = sigmoid(logit)
        n = len(y)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = ((prob - y) / n).astype(np.float32)
        g["out"], g["out_b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * self.p["out"]
        d_alpha = (states * d_pool).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["att_v"] = np.einsum("tn,tnk->k", d_e, s)
        d_s = d_e[:, :, None] * self.p["att_v"] * (1 - s * s)
        g["att"] = np.einsum("tnh,tnk->hk", states, d_s)
        d_states = alpha[:, :, None] * d_pool + d_s @ self.p["att"].T
        d_u = np.zeros_like(u)
        for side, name in enumerate(("forward", "back")):
            r_, carry = self.p[name], np.zeros((n, h), np.float32)
            d_own = np.zeros((len(u), 3 * h), np.float32)
            for k, before, r, z, new, g_new in reversed(kept[side]):
                d_now = d_states[k, :, h * side : h * (side + 1)] + carry
                d_a = d_now * (1 - z) * (1 - new * new)
                d_z = d_now * (before - new) * z * (1 - z)
                d_r = d_a * g_new * r * (1 - r)
                d_g = np.concatenate([d_r, d_z, d_a * r], 1)
                g[name] += before.T @ d_g
                carry = d_now * z + d_g @ r_.T
                np.add.at(d_own, ids[:, k], np.concatenate([d_r, d_z, d_a], 1))
            d_u[:, 3 * h * side : 3 * h * (side + 1)] = d_own
        g["bias"] = d_u.sum(0)
        d_u = d_u[:-1]
        g["input"] = x.T @ d_u
        d_x = d_u @ self.p["input"].T
        np.add.at(g["word"], rows, d_x[:, :WORD_SIZE])
        np.add.at(g["gram"], gram, (d_x[:, WORD_SIZE:] / np.sqrt(each)[:, None])[owner])
        return loss, g


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Of a toxic document, the windows that n-gram odds, then the network itself, find worst stand for it; of a clean one, windows drawn at random, then the worst."""
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}
    words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]  # one string for each word
    count = Counter(w for ws in words for w in set(ws))
    known = {w: k + 1 for k, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:KNOWN_WORDS]) if n >= 3}
    net = Network.new(known, rng)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
    label = np.array(toxic)
    if not number or len(set(toxic)) < 2:
        return net
    gram, owner = word_grams(list(number))
    at = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(number)))
    in_word, in_gram = np.zeros((2, len(number))), np.zeros((2, 1 << GRAM_BITS))
    for y, d in zip(label, docs):
        own = np.unique(d)
        if len(own):
            in_word[y, own] += 1
            in_gram[y, np.unique(np.concatenate([gram[at[ends[w - 1] if w else 0 : ends[w]]] for w in own]))] += 1
    share = (label == 1).mean()

    def lean(seen: np.ndarray) -> np.ndarray:
        """-1 to 1: how far the toxic documents that have something exceed their share."""
        expected = seen.sum(0) * share
        return np.clip((seen[1] - expected) / np.sqrt(expected + 1) / 4, -1, 1)

    # one number of each vector starts from the labels' counts; the fit goes on from there
    word_lean, gram_lean = lean(in_word), lean(in_gram)
    for w, k in known.items():
        net.p["word"][k, 0] = word_lean[number[w]]
    net.p["gram"][:, 0] = gram_lean
    worst = word_lean.copy()
    np.maximum.at(worst, owner, gram_lean[gram])
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    starts = [window_starts(len(d)) for d in docs]
    names, pad, t = list(number), len(number), 0
    windows = sum(1 if y else min(len(ss), FIT_WINDOWS) for y, ss in zip(label, starts))
    epochs = max(epochs, -(-128 * STEPS // windows))
    for epoch in range(epochs):
        if epoch in (epochs * 3 // 7, epochs * 5 // 7):
            ranked = []
            for a in range(0, len(words), 50):
                logit, of = net.windows(words[a : a + 50])
                cuts = np.searchsorted(of, np.arange(len(words[a : a + 50]) + 1))
                ranked += [logit[x:y] for x, y in zip(cuts, cuts[1:])]
        picked: list[tuple[np.ndarray, int]] = []
        for k, (y, d, ss) in enumerate(zip(label, docs, starts)):
            if not ss:
                continue
            if epoch >= epochs * 3 // 7:
                value = ranked[k]
            elif y:
                value = np.array([np.sort(worst[d[a : a + WINDOW]])[-2:].sum() for a in ss])
            else:
                value = rng.random(len(ss))
            best = np.argsort(-value)[: FIT_WINDOWS if not y else 1]
            picked += [(d[ss[b] : ss[b] + WINDOW], int(y)) for b in best]
        few = [k for k, (_, y) in enumerate(picked) if y]
        order = rng.permutation(np.concatenate([np.arange(len(picked)), np.repeat(few, max(0, len(picked) // (4 * max(1, len(few))) - 1))]).astype(np.int64))
        for a in range(0, len(order), 128):
            part = [picked[k] for k in order[a : a + 128]]
            ids = np.full((len(part), WINDOW), pad, np.int64)
            for k, (w, _) in enumerate(part):
                ids[k, : len(w)] = w
            own, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            some = [names[k] for k in own if k != pad]
            last = len(some)
            local = np.where(ids == pad, last, local)
            y = np.array([v for _, v in part], np.float32)
            _, g = net.step(local, net.vectors(some), y, last)
            t += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                m, s = adam[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                rate = 0.001 if k in ("word", "gram") else 0.01  # vectors learn slowly, or few documents are learnt by heart
                net.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> Network:
    """Fitted on at most so many labelled documents, those of the smallest hash of doc_id, none of them held out.

    A document with both labels counts as toxic; of rows that repeat a doc_id, the text that sorts first
    is read; texts of more than FIT_CHARS characters are not. Null texts count as empty."""
    rows = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    first = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, toxic).unionByName(first(0, clean))
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))  # toxic + clean rows at most
    found = found.where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_CHARS).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    sample = sorted((int(r["doc_id"]), int(r["y"]), r["text"] or "") for r in found.select("doc_id", "y", "text").collect())
    return fit([t for _, _, t in sample], [y for _, y, _ in sample])


def score(docs: DataFrame, net: Network, batch_chars: int = 300_000) -> DataFrame:
    """doc_id, score for each row of docs.

    Null and empty texts, and texts without a word, score 0. Null doc_id and repeated rows stay; an
    empty table gives no row; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the module's parameters

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            out, group, chars = [], [], 0
            for t in texts:
                group.append(t)
                chars += len(t or "")
                if chars >= batch_chars:
                    out.append(net.score(group))
                    group, chars = [], 0
            out.append(net.score(group))
            yield pd.DataFrame({"doc_id": ids_of(batch), "score": np.concatenate(out)})

    return with_ids(docs, "text").mapInPandas(freeing(scored), "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: Network, batch_chars: int = 300_000) -> DataFrame:
    """The rows of docs that the network doesn't reject, with all columns."""

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        net, out, group, chars = shared.value, [], [], 0
        for t in texts:
            group.append(t)
            chars += len(t or "")
            if chars >= batch_chars:
                out.append(net.score(group))
                group, chars = [], 0
        out.append(net.score(group))
        free()
        return pd.Series(np.concatenate(out))

    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.where(score_of("text") < THRESHOLD)
