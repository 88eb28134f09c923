"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows scores by the log of its frequency in each language. An unseen word
falls back to its character n-grams of the largest length of which the model knows any. Words and
n-grams are counted by Spark; the model keeps a fixed number of them, so it can be sent to tasks.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker

#: Training rows of each language (expected number: rows are taken by a hash of their id).
ROWS_PER_LANGUAGE = 10_000
#: Words and n-grams that the model keeps.
WORDS, GRAMS = 100_000, 100_000
LONGEST_GRAM = 5
UNKNOWN = "und"

_CHUNKS = 300_000
_LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches):
    """Task: words of each language, summed inside the task before they are shuffled."""
    from collections import Counter, defaultdict

    chunks = defaultdict(Counter)

    def flush():
        for lang, counted in chunks.items():
            words = Counter()
            for chunk, n in counted.items():
                for w in _LETTERS.findall(chunk):
                    words[w] += n
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "item", "n"],
                )
        chunks.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunks[lang].update(text.lower().split())
        if sum(map(len, chunks.values())) > _CHUNKS:
            yield from flush()
    yield from flush()


def _count_grams(batches):
    """Task: n-grams of the counted words, with the words' counts."""
    from collections import Counter

    for batch in batches:
        counted = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for size in range(1, LONGEST_GRAM + 1):
                for g in grams(word, size):
                    counted[lang, g] += n
        if counted:
            langs, items = zip(*counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(items), pa.array(list(counted.values()), pa.int64())], names=["lang", "item", "n"]
            )


def _frequencies(counts: DataFrame, langs: list[str], keep: int, group: Column) -> dict[str, tuple[float, ...]]:
    """Log frequencies of the ``keep`` items with the highest share in some language; items that
    occur once in all are unseen words."""
    counts = counts.groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", group)
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    wide = counts.groupBy("item", "size").agg(*[F.sum(F.when(F.col("lang") == v, F.col("n")).otherwise(0)).alias(f"n{i}") for i, v in enumerate(langs)])
    whole = {v: sum(n for (lang, _), n in totals.items() if lang == v) or 1 for v in langs}
    each = [F.col(f"n{i}") for i in range(len(langs))]
    share = F.array_max(F.array(*[c / F.lit(whole[v]) for c, v in zip(each, langs)]))
    top = wide.where(sum(each[1:], each[0]) > 1).orderBy(share.desc(), "item").limit(keep).collect()
    out = {}
    for r in top:
        out[r.item] = tuple(
            math.log((r[f"n{i}"] + 0.1) / (totals.get((v, r.size), 0) + 0.1 * keep)) for i, v in enumerate(langs)
        )
    return out


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learn from the rows with a language and a text. Of each language about
    ``ROWS_PER_LANGUAGE`` rows take part, chosen by a hash of the id (all, if there are fewer)."""
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for v in langs for x in (v, min(1.0, ROWS_PER_LANGUAGE / sizes[v]))])
    taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    schema = "lang string, item string, n long"
    words = taken.select("lang", "text").mapInArrow(_count_words, schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = words.persist()
    known = _frequencies(words, langs, WORDS, F.lit(0))
    shorter = _frequencies(words.mapInArrow(_count_grams, schema), langs, GRAMS, F.length("item"))
    words.unpersist()
    return Model(langs, known, shorter)


class Scorer:
    """Sums of word scores over texts; blank-separated chunks met before are looked up."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((_CHUNKS, len(model.langs) + 1))

    def word(self, word: str) -> tuple[float, ...] | list[float]:
        known = self.model.words.get(word)
        if known is not None:
            return known
        table = self.model.grams
        for n in range(LONGEST_GRAM, 0, -1):
            found = [v for v in map(table.get, grams(word, n)) if v is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(self.model.langs)

    def _row(self, chunk: str) -> int:
        at = len(self.seen)
        words = _LETTERS.findall(chunk.lower())
        total = [sum(c) for c in zip(*map(self.word, words))] or [0.0] * len(self.model.langs)
        self.rows[at] = (*total, len(words))
        self.seen[chunk] = at
        return at

    def total(self, text: str) -> np.ndarray:
        """Sums of the scores and, last, the number of words."""
        out = np.zeros(self.rows.shape[1])
        chunks = text.split()
        for start in range(0, len(chunks), 50_000):
            part = chunks[start : start + 50_000]
            if len(self.seen) + len(part) > len(self.rows):
                self.seen.clear()
            seen, row = self.seen, self._row
            out += self.rows[[seen[c] if c in seen else row(c) for c in part]].sum(0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.total(text or "")
        n = total[-1]
        if not n or not self.model.langs:
            return UNKNOWN, 0.0
        scores = total[:-1] / max(1.0, n / 20)
        p = np.exp(scores - scores.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the share of the best language).

    A text that is null or has no letters is ``und`` with score 0, as are all texts under a model
    that has seen no language; with equal scores the first language by name wins. Columns of
    ``df`` with these names are replaced; rows and their order of appearance stay.
    """
    spark = df.sparkSession
    sent, version = spark.sparkContext.broadcast((model.langs, model.words, model.grams)), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        scorer = kept_in_worker("language", lambda: Scorer(Model(*sent.value)), version)
        return pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    named = df.drop("lang_pred", "score")
    return named.withColumn("_best", best(text_col)).select(*named.columns, "_best.lang_pred", "_best.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: remainder 2 of the id's checksum by 4 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model of the rows not held out."""
    rows = df.select(F.col("doc_id").cast("long"), "text", "lang", held_out().alias("held_out"))
    model = train(rows.where("not held_out and doc_id is not null"))
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
