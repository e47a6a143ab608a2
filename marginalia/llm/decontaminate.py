"""Benchmark decontamination by suffix arrays of the training text (operator 2).

Documents are taken in shards of some MB.  Each shard gets a suffix array over its words: the places of its words,
sorted by the words that follow.  Every test suffix is then found in it by binary search, which gives the places of
its first ten words; test suffixes that start alike are looked for once, so a place is found once for each length of
window, however often the benchmark repeats itself.  From each place found, the longest verbatim match is the longer of
the agreements with its two neighbours in the order of all test suffixes.

Words outside the benchmark cannot be part of a match, so the words of a shard are numbered by the benchmark's
vocabulary and places of other words are left out.  The array is sorted by as many words as fit into 64 bits first;
only the stretches that a test suffix points into are sorted further, by ten words.

Words are told apart by a 64-bit hash.  The benchmark is sent to the tasks in blocks of at most ``ITEM_BYTES`` of
text; a larger benchmark takes one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import ALPHANUMERIC, LOWER, Hasher, Texts, _powers, batches, in_arrow, mixed, runs

WINDOW = 10
ITEM_BYTES = 8 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words before each text and in all)."""
    batch = Texts(texts)
    batch.data = LOWER[batch.data]
    starts, ends, firsts = batch.words(ALPHANUMERIC)
    return Hasher(batch.data).spans(starts, ends), firsts


class TestSuffixes:
    """The suffixes of the benchmark's items that have a window, with what a search in a suffix array needs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        hashes, firsts = word_hashes([text for _, text in items])
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key, self.window = 64 // self.bits, window
        self.keys = -(-window // self.per_key)
        words = np.concatenate([numbers.astype(np.uint64) + np.uint64(1), np.zeros(window, np.uint64)])
        counts = np.diff(firsts)
        lengths = np.minimum(counts, window)
        starts = [np.arange(f, f + n - w + 1) for f, n, w in zip(firsts[:-1], counts, lengths, strict=True) if n]
        owners = [i for i, n in enumerate(counts) if n]
        self.place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        item = np.repeat(owners, [len(s) for s in starts]).astype(np.int64)
        self.names = [name for name, _ in items]
        self.length = lengths[item]
        low, high = self._bounds(words)
        _, first, same = np.unique(as_bytes(np.concatenate([low, high], axis=1)), return_index=True, return_inverse=True)
        low, high, self.length = low[first], high[first], self.length[first]
        self.first_low, self.first_high = low[:, 0], high[:, 0]
        self.low, self.high = as_bytes(low), as_bytes(high)
        # Items of each window: those of window w are item_of[items_at[w]:items_at[w + 1]].
        pairs = np.unique(same * max(1, len(items)) + item)
        self.item_of = pairs % max(1, len(items))
        self.items_at = np.searchsorted(pairs // max(1, len(items)), np.arange(len(first) + 1))
        self.order = SuffixOrder(numbers, firsts)

    def _bounds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest keys of texts that start with the window of each suffix."""
        low = np.zeros((len(self.place), self.keys), np.uint64)
        high = np.zeros_like(low)
        full = np.uint64((1 << self.bits) - 1)
        for w in range(self.keys * self.per_key):
            key, shift = w // self.per_key, np.uint64(self.bits * (self.per_key - 1 - w % self.per_key))
            known = w < self.length
            word = words[np.minimum(self.place + w, len(words) - 1)]
            low[:, key] |= np.where(known, word, np.uint64(0)) << shift
            high[:, key] |= np.where(known, word, full) << shift
        return low, high

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window in ``numbers``, the words of a shard, 0 for others."""
        padded = np.concatenate([numbers, np.zeros(self.keys * self.per_key, np.uint64)])
        places = np.nonzero(numbers)[0]
        first = self._key(padded, places, 0)
        order = np.argsort(first)
        places, first = places[order], first[order]
        begin = np.searchsorted(first, self.first_low, "left")
        end = np.searchsorted(first, self.first_high, "right")
        wanted = np.zeros(len(places) + 1, np.int64)
        np.add.at(wanted, begin, 1)
        np.add.at(wanted, end, -1)
        places = places[np.cumsum(wanted[:-1]) > 0]
        keys = as_bytes(np.stack([self._key(padded, places, k) for k in range(self.keys)], axis=1))
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        begin = np.searchsorted(keys, self.low, "left")
        found = np.maximum(np.searchsorted(keys, self.high, "right") - begin, 0)
        window = np.repeat(np.arange(len(found)), found)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
        return places[np.repeat(begin, found) + inside], window

    def items(self, windows: np.ndarray) -> np.ndarray:
        """The items that have any of ``windows``."""
        windows = np.unique(windows)
        begin, count = self.items_at[windows], np.diff(self.items_at)[windows]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(self.item_of[np.repeat(begin, count) + inside])

    def _key(self, padded: np.ndarray, places: np.ndarray, key: int) -> np.ndarray:
        """Words ``key * per_key`` onward of the suffixes at ``places``; a 0 ends the suffix."""
        value = np.zeros(len(places), np.uint64)
        alive = np.ones(len(places), bool)
        for w in range(key * self.per_key):
            alive &= padded[places + w] > 0
        for w in range(self.per_key):
            word = padded[places + key * self.per_key + w]
            alive &= word > 0
            value = (value << np.uint64(self.bits)) | np.where(alive, word, np.uint64(0))
        return value


class Sums:
    """Hashes of stretches of numbers in constant time each."""

    def __init__(self, codes: np.ndarray):
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers("up", len(codes)), dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * _powers("down", len(self.prefix))[start]


class SuffixOrder:
    """All suffixes of the items in the order of their words, to find how long a text agrees with any of them."""

    def __init__(self, numbers: np.ndarray, firsts: np.ndarray):
        """``numbers`` are the words of all items; item i has those from ``firsts[i]`` to ``firsts[i + 1]``."""
        count = len(firsts) - 1
        owner = np.repeat(np.arange(count), np.diff(firsts))
        self.ends, place = count, np.arange(len(numbers)) + owner
        # After each item stands an end of its own, below all words, so no two suffixes are the same.
        self.words = np.zeros(len(numbers) + count, np.int64)
        self.words[place] = numbers + count
        self.words[firsts[1:] + np.arange(count)] = np.arange(count)
        self.item = np.zeros(len(self.words), np.int32)
        self.item[place] = owner
        self.longest = int(np.diff(firsts).max(initial=0))
        rank, reach = self.words, 1
        while reach <= self.longest:
            after = np.full(len(rank), -1, np.int64)
            after[:-reach] = rank[reach:]
            _, rank = np.unique(rank * (len(rank) + count + 2) + after + 1, return_inverse=True)
            reach *= 2
        self.sorted = np.argsort(rank, kind="stable")
        self.sorted = self.sorted[self.words[self.sorted] >= count].astype(np.int32)
        self.sums = Sums(mixed(self.words.astype(np.uint64)))

    def agreement(self, sums: Sums, place: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """How many words from each ``place`` of a text are those of the suffix at ``suffix``."""
        same = np.zeros(len(place), np.int64)
        step = 1 << self.longest.bit_length()
        while step := step // 2:
            longer = same + step
            fits = (place + longer < len(sums.prefix)) & (suffix + longer < len(self.sums.prefix))
            p, q, n = place[fits], suffix[fits], longer[fits]
            equal = sums.of(p, n) == self.sums.of(q, n)
            same[np.nonzero(fits)[0][equal]] += step
        return same

    def read(self, numbers: np.ndarray) -> tuple[np.ndarray, Sums]:
        """A text's words as those of the items, -1 for others, and its sums; -1 agrees with nothing."""
        words = np.where(numbers > 0, numbers.astype(np.int64) - 1 + self.ends, -1)
        codes = np.where(words >= 0, words, np.arange(len(words)) + (1 << 40))
        return words, Sums(mixed(codes.astype(np.uint64)))

    def longest_match(self, words: np.ndarray, sums: Sums, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of the longest agreement from each ``place``, where it would stand among the sorted suffixes)."""
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(self.sorted), np.int64)
        text, known = np.append(words, -1), np.append(self.words, -1)
        while (open_ := np.nonzero(low < high)[0]).size:
            middle = (low[open_] + high[open_]) // 2
            suffix = self.sorted[middle]
            same = self.agreement(sums, place[open_], suffix)
            above = text[place[open_] + same] > known[suffix + same]
            low[open_[above]] = middle[above] + 1
            high[open_[~above]] = middle[~above]
        best = np.zeros(len(place), np.int64)
        for neighbour in (low - 1, low):
            real = np.nonzero((neighbour >= 0) & (neighbour < len(self.sorted)))[0]
            best[real] = np.maximum(best[real], self.agreement(sums, place[real], self.sorted[neighbour[real]]))
        return best, low

    def first_item(self, sums: Sums, place: int, length: int, at: int) -> int:
        """The first item of those that agree with ``length`` words from ``place``; they stand around ``at``."""

        def agrees(k: int) -> bool:
            return int(self.agreement(sums, np.array([place]), self.sorted[k : k + 1])[0]) >= length

        def edge(inside: int, outside: int) -> int:
            while abs(outside - inside) > 1:
                middle = (inside + outside) // 2
                inside, outside = (middle, outside) if agrees(middle) else (inside, middle)
            return inside

        first = at if at < len(self.sorted) and agrees(at) else at - 1
        return int(self.item[self.sorted[edge(first, -1) : edge(first, len(self.sorted)) + 1]].min())


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows of 64-bit keys as byte strings in the same order."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel()


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "n_words long, items array<string>, spans array<struct<start:long,end:long>>, longest long, longest_item string, longest_start long"


def matches(tests: TestSuffixes, texts: list[bytes]) -> dict[str, list]:
    """The columns of FOUND for each text of a shard."""
    hashes, firsts = word_hashes(texts)
    size = len(tests.vocabulary)
    spot = np.minimum(np.searchsorted(tests.vocabulary, hashes), max(size - 1, 0))
    known = tests.vocabulary[spot] == hashes if size else np.zeros(len(hashes), bool)
    # A 0 between texts keeps matches from crossing.
    shift = np.repeat(np.arange(len(texts)), np.diff(firsts))
    numbers = np.zeros(len(hashes) + len(texts) + 1, np.uint64)
    numbers[np.arange(len(hashes)) + shift] = np.where(known, spot + 1, 0)
    place, window = tests.search(numbers)
    text = np.searchsorted(firsts + np.arange(len(firsts)), place, "right") - 1
    columns = {"n_words": np.diff(firsts), "items": [[]] * len(texts), "spans": [[]] * len(texts)}
    columns |= {"longest": [0] * len(texts), "longest_item": [None] * len(texts), "longest_start": [None] * len(texts)}
    if not len(place):
        return columns
    order = np.lexsort((place, text))
    text, place, window = text[order], place[order], window[order]
    words, sums = tests.order.read(numbers)
    # A window that is a whole short item counts as long as it is; an agreement counts from a window's length on.
    agreed, among = tests.order.longest_match(words, sums, place)
    long = np.where(agreed >= tests.window, agreed, tests.length[window])
    for t, part in runs(text):
        start = place[part] - firsts[t] - t
        columns["items"][t] = sorted({tests.names[i] for i in tests.items(window[part]) if tests.names[i] is not None})
        columns["spans"][t] = union(start, start + tests.length[window[part]])
        best = part.start + int(np.argmax(long[part]))
        columns["longest"][t] = int(long[best])
        columns["longest_start"][t] = int(place[best] - firsts[t] - t)
        if agreed[best] >= tests.window:
            item = tests.order.first_item(sums, int(place[best]), int(long[best]), int(among[best]))
        else:
            item = int(tests.items(window[best : best + 1])[0])
        columns["longest_item"][t] = tests.names[item]
    return columns


def union(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Overlapping and touching spans joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.nonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))[0]
    last = np.concatenate([cut[1:] - 1, [len(starts) - 1]])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[cut], ends[last], strict=True)]


def item_blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    """``items`` in blocks of about ``limit`` bytes, by running size over hashed parts."""
    rows = items.select(F.col("item_id").cast("string").alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long") + 64
    total, largest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if total <= limit:
        return [rows]
    parts = -(-2 * total // limit)
    spread = rows.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.groupBy("part").agg(F.sum(size).alias("size")).withColumn("block", F.floor(F.sum("size").over(before) / limit))
    blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").collect()]
    return [spread.join(placed.filter(F.col("block") == b), "part").select("name", "text") for b in blocks]


def find_benchmark(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """``docs`` with n_words, items, spans (merged hit words, end excluded), longest, longest_item and longest_start.

    ``items`` has item_id and text.  A window is ``window`` consecutive words of an item, or the whole of a shorter
    item; items without words, null or empty ones, have none, and items without an id are found but not named.
    Documents without text have no words.  Repeated rows are rows of their own.  Of equally long matches the first of the
    document counts, and of items that have it the first by name.  The columns of ``docs`` in ``carry``,
    all by default, are carried; those named like a result are replaced.
    """
    names = T.StructType.fromDDL(FOUND).names
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    result = docs.select(F.struct(F.lit(0), *kept).alias("row"), F.col("text").cast("string").alias("text"))
    blocks = item_blocks(items, item_bytes)
    for number, block in enumerate(blocks):
        result = _find_block(result, block, window, number, number + 1 == len(blocks))
    if len(blocks) > 1:
        result = result.select("row", *_merged(len(blocks)))
    else:
        result = result.select("row", *[F.col(f"{n}_0").alias(n) for n in names])
    return result.select(*[F.col("row")[c].alias(c) for c in kept], *names)


def _find_block(rows: DataFrame, block: DataFrame, window: int, number: int, last: bool) -> DataFrame:
    """``rows`` with the columns of FOUND, numbered; without their text after the last block."""
    items = [(r["name"], r["text"].encode()) for r in block.orderBy("name", "text").collect()]
    tests = rows.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))
    added = [T.StructField(f"{f.name}_{number}", f.dataType) for f in T.StructType.fromDDL(FOUND)]
    schema = T.StructType([f for f in rows.schema if f.name != "text" or not last] + added)
    kinds = {"items": pa.list_(pa.string()), "spans": pa.list_(SPAN), "longest_item": pa.string()}

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream):
            columns = {name: rest.column(name).combine_chunks() for name in rest.column_names}
            if not last:
                columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            for name, values in matches(tests.value, texts).items():
                columns[f"{name}_{number}"] = pa.array(values, kinds.get(name, pa.int64()))
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], names=[f.name for f in schema])

    return in_arrow(rows, search, schema)


def _merged(blocks: int) -> list:
    """Results of several blocks as one: items joined, spans merged, the longest match kept."""
    col = lambda name: [F.col(f"{name}_{b}") for b in range(blocks)]
    spans = F.array_sort(F.flatten(F.array(*col("spans"))))
    start = F.lit(None).cast("array<struct<start:long,end:long>>")

    def join(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touching = span["start"] <= last["end"]
        return (
            F.when(done.isNull(), F.array(span))
            .when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))
            .otherwise(F.concat(done, F.array(span)))
        )

    best = F.array_max(F.array(*[F.struct(*[F.col(f"{n}_{b}").alias(n) for n in ("longest", "longest_item", "longest_start")]) for b in range(blocks)]))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    return [
        F.col("n_words_0").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*col("items"))))).alias("items"),
        F.coalesce(F.aggregate(spans, start, join), empty).alias("spans"),
        *[best[n].alias(n) for n in ("longest", "longest_item", "longest_start")],
    ]


def hit_words(spans) -> object:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of ``items``, with all their columns."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    return find_benchmark(whole, items, window).filter(F.size("spans") == 0).select("row.*")
