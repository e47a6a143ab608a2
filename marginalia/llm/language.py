"""Language identification as inference in a multilingual mixture (operator 6).

A document is a mixture of languages: each of its letter trigrams is drawn from one of them.  Expectation maximisation
estimates the proportions; sets of the leading languages are then compared by likelihood less a penalty per language,
and the first in the chosen set is predicted.  The model is the counts of hashed trigrams by language over all
labelled documents, 512 KB per language; more than MOST_CELLS / BUCKETS languages share as much by coarser hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import END, Texts, batches, in_arrow, runs

BUCKETS = 1 << 16
MOST_CELLS = 1 << 25
SMOOTHING = 0.1
PENALTY = 6.0
ROUNDS = 40
UNDETERMINED = "und"

# Lower-case ASCII letters and bytes beyond ASCII stand for themselves, all else for a blank.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram that is not all blanks, number of trigrams before each text and in all).

    A blank stands before and after each text, so that a single letter has a trigram.
    """
    batch = Texts([b" " + text + b" " for text in texts])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    data = FOLD[batch.data]
    a, b, c = data[:-2], data[1:-1], data[2:]
    codes = (a.astype(np.uint32) << 16) | (b.astype(np.uint32) << 8) | c
    used = (codes != 0x202020) & (a != END) & (b != END) & (c != END)
    places = np.nonzero(used)[0]
    hashed = (codes[places] * np.uint32(2654435761)) >> np.uint32(16)
    return hashed.astype(np.int64), np.searchsorted(places, batch.starts)


def has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode())


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over ``docs`` (text, lang)."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                some = np.nonzero(counts)[0]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])
            held.clear()

        for rest, texts in batches(stream):
            buckets, firsts = features(texts)
            coded = rest.column("lang").combine_chunks().dictionary_encode()
            owner = np.repeat(coded.indices.to_numpy().astype(np.int64), np.diff(firsts))
            order = np.argsort(owner, kind="stable")
            for number, part in runs(owner[order]):
                lang = coded.dictionary[number].as_py()
                counts = np.bincount(buckets[order[part]], minlength=BUCKETS)
                held[lang] = held[lang] + counts if lang in held else counts
            if len(held) > 50:
                yield from flushed()
        yield from flushed()

    return in_arrow(docs, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram probabilities by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts`` by bucket and language; its lines are a power of two, BUCKETS or fewer."""
        self.languages, self.fold = languages, BUCKETS // len(counts)
        totals = counts.sum(axis=0, keepdims=True)
        self.probability = np.ascontiguousarray((counts + SMOOTHING) / (totals + SMOOTHING * len(counts)))

    def proportions(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Most likely proportions and the likelihood's logarithm, for ``p`` by trigram and language, ``n`` counts."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(ROUNDS):
            mixed = p @ share
            new = share * ((n / mixed) @ p) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(n @ np.log(p @ share))

    def predict(self, buckets: np.ndarray) -> tuple[str, float]:
        if not self.languages or not len(buckets):
            return UNDETERMINED, 0.0
        seen, n = np.unique(buckets // self.fold, return_counts=True)
        p, n = self.probability[seen], n.astype(np.float64)
        share, _ = self.proportions(p, n)
        lead = np.argsort(-share, kind="stable")
        penalty = PENALTY * np.log(1 + n.sum())
        best, chosen = -np.inf, (lead[:1], np.ones(1))
        for size in range(1, len(lead) + 1):
            own, likelihood = self.proportions(p[:, lead[:size]], n)
            if likelihood - penalty * size <= best:
                break
            best, chosen = likelihood - penalty * size, (lead[:size], own)
        top = int(np.argmax(chosen[1]))
        return self.languages[int(chosen[0][top])], float(chosen[1][top])


def learn(docs: DataFrame) -> Mixture:
    """A mixture of the languages in ``docs`` (text, lang); rows without lang or text teach nothing.

    The model has at most MOST_CELLS counts: buckets are halved until those of all languages fit.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    counts = count_trigrams(known)
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    size = BUCKETS
    while size > 1 and size * len(languages) > MOST_CELLS:
        size //= 2
    table = np.zeros((size, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    for lang, bucket, n in packed.toLocalIterator():
        np.add.at(table[:, place[lang]], np.array(bucket, dtype=np.int64) // (BUCKETS // size), n)
    return Mixture(languages, table)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the checksum of their id; those without an id too."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """``docs`` without text, with lang_pred and score, the predicted language's share of the document.

    Null texts, texts without a letter and all texts if nothing was learned are ``und`` with score 0.  Columns are
    carried, those named like a result replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream):
            buckets, firsts = features(texts)
            found = [
                sent.value.predict(buckets[a:b]) if has_letter(text) else (UNDETERMINED, 0.0)
                for text, a, b in zip(texts, firsts[:-1], firsts[1:], strict=True)
            ]
            columns = [rest.column("row").combine_chunks(), pa.array([f[0] for f in found], pa.string())]
            columns.append(pa.array([f[1] for f in found], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"])

    rows = docs.select(F.struct(F.lit(0), *kept).alias("row"), docs["text"].cast("string").alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return in_arrow(rows, predict, schema).select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")
