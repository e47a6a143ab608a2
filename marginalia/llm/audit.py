"""Filter interaction audit (operator 13): what five filters remove in each of their 120 orders.

Words, capitals, code points and symbols of a text are counted in one pass of a table-driven transducer over its UTF-8
bytes.  Its states are "between words" and "in a word"; NEXT gives the state after a byte and EMIT what the byte emits
in a state: a word's start or end, a capital, a code point (no continuation byte), a symbol.  The state after a byte
depends on the byte alone, so the states of a whole batch are one look-up.

The spans of words go into an open-addressing hash table under their text and hash; whatever meets in a slot is compared
byte by byte, and a different word goes on to the next slot.

Each document then is one of 32 patterns of failed filters; the orders are counted on patterns, not on documents.  Equal
texts are told apart by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import END, UNBLANK, Hasher, Texts, batches, byte_set, in_arrow, mixed

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = "#$%&*|"

BETWEEN, INSIDE = 0, 1
STARTS, ENDS, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(state after, what is emitted) by state and byte."""
    after = np.where(UNBLANK, INSIDE, BETWEEN).astype(np.uint8)
    emit = np.zeros(256, np.uint8)
    emit[byte_set((65, 90))] |= CAPITAL
    emit[~byte_set((128, 191), (END, END))] |= POINT
    emit[list(SYMBOLS.encode())] |= SYMBOL
    return after, np.stack([emit | np.where(UNBLANK, STARTS, 0).astype(np.uint8), emit | np.where(UNBLANK, 0, ENDS).astype(np.uint8)])


NEXT, EMIT = _tables()


def transduce(data: np.ndarray) -> np.ndarray:
    """What each byte emits; the first byte is read between words."""
    before = np.empty(len(data), np.uint8)
    before[:1] = BETWEEN
    np.take(NEXT, data[:-1], out=before[1:])
    return EMIT[before, data]


LAST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
LONG_SPAN = 4096


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes from ``a`` on are those from ``b`` on, eight at a time; ``data`` goes on 7 bytes more."""
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    same = np.ones(len(a), bool)
    for i in np.nonzero(sizes > LONG_SPAN)[0].tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + sizes[i]], data[b[i] : b[i] + sizes[i]])
    left, at = np.nonzero((sizes > 0) & (sizes <= LONG_SPAN))[0], 0
    while len(left):
        mask = LAST_BYTES[np.minimum(sizes[left] - at, 8)]
        equal = ((eights[a[left] + at] ^ eights[b[left] + at]) & mask) == 0
        same[left[~equal]] = False
        at += 8
        left = left[equal & (sizes[left] > at)]
    return same


def first_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Marks the spans whose bytes no other span of the same owner put into the table before."""
    sizes, count = ends - starts, len(starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    mask = np.uint64((1 << max(4, (2 * count).bit_length())) - 1)
    table = np.full(int(mask) + 1, -1, np.int64)
    place = hashes & mask
    fresh = np.zeros(count, bool)
    waiting = np.arange(count)
    while len(waiting):
        slot = place[waiting].astype(np.int64)
        free = table[slot] < 0
        # Of spans that want one free slot the first gets it.
        table[slot[free][::-1]] = waiting[free][::-1]
        holder = table[slot]
        own = holder == waiting
        fresh[waiting[own]] = True
        met, other = waiting[~own], holder[~own]
        alike = (owners[met] == owners[other]) & (sizes[met] == sizes[other]) & (hashes[met] == hashes[other])
        alike[alike] = same_bytes(padded, starts[met[alike]], starts[other[alike]], sizes[met[alike]])
        waiting = met[~alike]
        place[waiting] = (place[waiting] + np.uint64(1)) & mask
    return fresh


def figures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points and symbols of each text."""
    batch = Texts(texts)
    if not texts:
        return dict.fromkeys(("words", "distinct", "capitals", "points", "symbols"), np.zeros(0, np.int64))
    emitted = transduce(batch.data)
    count = lambda mark: np.add.reduceat(emitted & mark != 0, batch.starts[:-1], dtype=np.int64)
    starts, ends = np.nonzero(emitted & STARTS)[0], np.nonzero(emitted & ENDS)[0]
    owners = np.searchsorted(batch.starts, starts, "right") - 1
    hashes = mixed(Hasher(batch.data).spans(starts, ends) + owners.astype(np.uint64))
    fresh = first_spans(batch.data, starts, ends, owners, hashes)
    return {
        "words": np.bincount(owners, minlength=len(texts)),
        "distinct": np.bincount(owners[fresh], minlength=len(texts)),
        "capitals": count(CAPITAL),
        "points": count(POINT),
        "symbols": count(SYMBOL),
    }


def failures(found: dict[str, np.ndarray]) -> np.ndarray:
    """Failed filters A to D of each text, as bits."""
    tests = [
        found["words"] < MIN_WORDS,
        100 * found["distinct"] < MIN_DISTINCT_PERCENT * found["words"],
        100 * found["capitals"] > MAX_CAPITAL_PERCENT * found["points"],
        found["symbols"] > 0,
    ]
    return sum(test.astype(np.int32) << i for i, test in enumerate(tests))


def judge_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest) per row: failed filters A to D as bits, and the SHA-256 of the text."""

    def judged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream):
            fails = failures(figures(texts))
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            columns = [rest.column(c).combine_chunks() for c in ("doc_id", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fails, pa.int32()), digests], names=["doc_id", "part", "fails", "digest"])

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").alias("text"))
    return in_arrow(rows, judged, "doc_id long, part string, fails int, digest binary")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, documents, good, toxic): documents by the set of filters that they fail, as bits, E included.

    Equal texts meet as counts: rows of a document first, then a part's documents of one text, then all of a text.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = judge_texts(docs).join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "fails", "good", "toxic"]
    single = known.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = single.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    kept = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    repeated = groups.withColumn("least", least).withColumn("repeats", F.col("with_id") - kept)
    both = F.array(
        F.struct(F.col("fails"), (F.col("n") - F.col("repeats")).alias("n")),
        F.struct((F.col("fails") + (1 << FILTERS.index("E"))).alias("fails"), F.col("repeats").alias("n")),
    )
    counted = repeated.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.*")
    number = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return counted.groupBy("part", "fails").agg(
        F.sum("n").alias("documents"), number(F.col("good")).alias("good"), number(F.col("toxic")).alias("toxic")
    )


def steps() -> Column:
    """All steps of all orders: filter_order, step, the filters before it and its own, as bits."""
    entries = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            entries.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")))
            before |= own
    return F.array(*entries)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` (doc_id, text, source), ``labels`` (doc_id, quality, toxic).  The part is the source, '' for null.  A null
    text is empty.  Filter E finds texts that a row of smaller doc_id has in any part: repeated rows of one doc_id never
    fail it because of each other, and rows without a doc_id neither fail it nor make others fail.  A document is good or
    toxic if any of its labels says so; labels of null are none.  Every row of ``docs`` counts, also repeated ones.
    Without documents there is no part, so no row.  Further columns are ignored.
    """
    rows = patterns(docs, labels).select("*", F.explode(steps()).alias("s")).select("part", "fails", "documents", "good", "toxic", "s.*")
    fails = F.col("fails")
    own, earlier = fails.bitwiseAND(F.col("own")) != 0, fails.bitwiseAND(F.col("before")) != 0
    # A document is removed by each of its n failed filters in 120 / n of the orders.
    share = 120 / F.greatest(F.bit_count(fails), F.lit(1))
    total = lambda when, value: F.sum(F.when(when, value).otherwise(0)).cast("long")
    documents = F.col("documents")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~own & ~earlier, documents).alias("kept"),
        total(own & ~earlier, documents).alias("removed"),
        total(own & earlier, documents).alias("redundant"),
        total(fails == F.col("own"), documents).alias("unique_fails"),
        total(own & ~earlier, F.col("good")).alias("good_lost"),
        total(own & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(own, (documents * share).cast("long")).alias("shapley"),
    )
