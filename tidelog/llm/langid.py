"""Operator 10: language identification by a string kernel.

The kernel of two texts is the share of distinct character n-grams (n = 1 to 4) that both have: the
inner product of their presence vectors, over the vectors' lengths. Landmark texts span a Nyström
approximation of it, and ridge regression, one language against the rest, is fitted there.
Since a kernel value is an inner product, landmarks and weights multiply into one matrix, and a batch
of texts is scored by one product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import freeing, ids_of, table, with_ids

LENGTHS = (1, 2, 3, 4)
#: n-grams are told apart by a hash of so many bits.
HASH_BITS = 20
#: The fit's bounds: languages (those of most documents), labelled texts of each, characters of a text, and landmarks among them.
LANGUAGES, FIT_TEXTS, FIT_CHARS, LANDMARKS, RIDGE = 100, 300, 100_000, 40, 1e-2
#: Scores are a softmax of the regressions' values, times this.
SHARPNESS = 6.0
UNKNOWN = "und"


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram) index pairs, with repeats, for each n. Letters count in lower case; no n-gram spans two texts or U+0000."""
    gap = "\0" * max(LENGTHS)
    low = [t.lower() for t in texts]
    chars = np.frombuffer((gap.join(low) + gap).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(low)), [len(t) + len(gap) for t in low])
    code = np.zeros(len(chars), np.uint32)
    valid = np.ones(len(chars), bool)
    for n in range(1, max(LENGTHS) + 1):
        own = chars[n - 1 :]
        code = (code[: len(own)] + own + np.uint32(n)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        valid = valid[: len(own)] & (own != 0)
        if n in LENGTHS:
            yield owner[: len(own)][valid], (code[valid] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each n-gram; -1: in no landmark
    weights: np.ndarray  # columns by languages

    def presence(self, texts: list[str]) -> np.ndarray:
        return self.read(texts)[0]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the landmarks' n-grams each text has, and how many distinct n-grams it has in all, as a column."""
        n = len(self.weights)
        seen = np.zeros(len(texts) * n, bool)
        ids, owners = [], []
        for owner, gram in grams(texts):
            col = self.column[gram]
            known = col >= 0
            seen[owner[known] * n + col[known]] = True
            ids.append(gram)
            owners.append(owner)
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        ids, cuts = ids[order], np.cumsum(np.bincount(owners, minlength=len(texts)))
        mark, total = np.zeros(1 << HASH_BITS, bool), np.zeros((len(texts), 1), np.float32)
        for k, (a, b) in enumerate(zip([0, *cuts.tolist()], cuts.tolist())):
            mark[ids[a:b]] = True
            total[k] = np.count_nonzero(mark)
            mark[ids[a:b]] = False
        return seen.reshape(len(texts), n).astype(np.float32), total

    def scores(self, texts: list[str]) -> np.ndarray:
        """The regressions' values, a row for each text."""
        x, total = self.read(texts)
        return (x @ self.weights) / np.sqrt(np.maximum(total, 1))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score of 0 to 1). Null texts, texts without a letter and an empty model: und, 0."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        todo = [k for k, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if todo:
            value = SHARPNESS * self.scores([texts[k] for k in todo])
            p = np.exp(value - value.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k, best, row in zip(todo, p.argmax(1), p):
                out[k] = self.languages[best], float(row[best])
        return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """texts in a fixed order; the first landmarks of each language are the Nyström points."""
    names = sorted(set(languages))
    column = np.full(1 << HASH_BITS, -1, np.int32)
    if not names:
        return Model([], column, np.zeros((0, 0), np.float32))
    count: dict[str, int] = {}
    marks = []
    for k, lang in enumerate(languages):
        count[lang] = count.get(lang, 0) + 1
        if count[lang] <= landmarks:
            marks.append(k)
    known = np.unique(np.concatenate([g for k in range(0, len(marks), 64) for _, g in grams([texts[m] for m in marks[k : k + 64]])]))
    column[known] = np.arange(len(known))
    empty = Model(names, column, np.zeros((len(known), len(names)), np.float32))
    unit = lambda some: (lambda x, total: x / np.sqrt(np.maximum(total, 1)))(*empty.read(some))
    z = unit([texts[m] for m in marks])
    k_nm = np.concatenate([unit(texts[k : k + 64]) @ z.T for k in range(0, len(texts), 64)]).astype(np.float64)
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k_nm @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    each = 1.0 / np.array([languages.count(x) for x in names])[[names.index(x) for x in languages]]  # every language weighs the same
    gram = phi.T @ (phi * each[:, None]) + ridge * np.eye(phi.shape[1])
    dual = root @ np.linalg.solve(gram, phi.T @ (y * each[:, None]))
    return Model(names, column, (z.T.astype(np.float64) @ dual).astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = FIT_TEXTS, languages: int = LANGUAGES) -> Model:
    """Fitted on at most per_language rows of each language, those of the smallest hash of doc_id and text, not held out, with text and lang.

    Rows that repeat a doc_id are rows of their own: each text is learnt with its own lang; equal rows
    count as one. Texts of more than FIT_CHARS characters are not learnt, nor languages but those of
    most rows (ties: by name)."""
    text_hash = F.xxhash64("text").alias("text_hash")
    usable = ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= FIT_CHARS)
    rows = docs.where(usable).select("doc_id", "lang", text_hash)
    names = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id", "text_hash")
    first = rows.join(F.broadcast(names.select("lang")), "lang").withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") <= per_language).distinct()
    keys = first.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash"), "_k")
    texts = docs.where(usable).select("doc_id", "lang", "text", text_hash)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_hash") == F.col("_hash"))
    chosen = texts.join(F.broadcast(keys), same).groupBy("lang", "_k").agg(F.min("text").alias("text"))  # per_language * languages rows at most
    found = sorted((r["lang"], r["_k"], r["text"]) for r in chosen.collect())
    return fit([t for _, _, t in found], [lang for lang, _, _ in found])


def identify(docs: DataFrame, model: Model, batch_chars: int = 400_000) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs.

    Null text and text without a letter: und with score 0, as everything is where nothing could be
    learned. Null doc_id and repeated rows stay; an empty table gives no row; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            found: list[tuple[str, float]] = []
            group: list[str | None] = []
            chars = 0
            for t in texts:
                group.append(t)
                chars += len(t or "")
                if chars >= batch_chars or len(group) == 128:
                    found += m.predict(group)
                    group, chars = [], 0
            found += m.predict(group)
            yield pd.DataFrame({"doc_id": ids_of(batch), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return with_ids(docs, "text").mapInPandas(freeing(predict), "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
