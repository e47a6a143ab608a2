"""SimHash near duplicates by multi-index hashing (operator 11).

A document's fingerprint has bit i set if more than half of its word shingles, repeats included, have bit i set in their
XXH64 (seed 42).  Fingerprints that differ in at most DISTANCE = 3 of 64 bits are linked.

Search: a fingerprint is cut into two segments of 32 bits.  Of two that differ in three bits, one segment differs in at
most one, so every fingerprint is filed under both of its segments and looks up the ball of radius 1 around each.  Two
neighbours in such a ball differ in one bit which just one of them has set, so it is enough that this one looks up its
segment with the bit cleared.  What meets in a bucket is verified on all 64 bits.

A bucket that more than CROWD fingerprints are filed under is cut by a second index: the other segment differs in at
most three bits, so one of its halves of 16 bits differs in at most one, and the bucket's rows go by both halves and
their balls of radius 1.  No more than 2**16 fingerprints can share a bucket of that index.

Equal fingerprints are one node.  A task compares the rows of its buckets and hands on a forest of the nodes it found
linked, one row per node, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, UNBLANK, Texts, batches, in_arrow, stored
from marginalia.llm.components import components

SHINGLE_WORDS, SEED = 3, 42
BITS, SEGMENT, HALF, DISTANCE = 64, 32, 16, 3
CROWD = 4096
PAIRS = 1 << 20  # compared at a time
BLOCK = 1 << 16  # shingles whose bits are counted at a time


def shingle_spans(firsts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, text) of every shingle; text t has the words firsts[t] to firsts[t + 1]."""
    counts = np.diff(firsts)
    own = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), own)
    first = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + firsts[text]
    return first, np.minimum(first + words, firsts[text + 1]) - 1, text


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each text as an unsigned number; zero for a text without words."""
    batch = Texts(texts)
    starts, ends, firsts = batch.words(UNBLANK)
    # Words one blank apart: the byte after each word becomes that blank, all other blanks go.
    kept = UNBLANK[batch.data]
    kept[ends] = True
    line = LOWER[batch.data]
    line[ends] = 32
    line = line[kept].tobytes()
    stops = np.cumsum(ends - starts + 1) - 1
    begins = stops - (ends - starts)
    first, last, text = shingle_spans(firsts, words)
    sums = np.zeros((len(texts), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        part = slice(at, at + BLOCK)
        spans = zip(begins[first[part]].tolist(), stops[last[part]].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.nonzero(np.diff(text[part], prepend=-1))[0]
        sums[text[part][cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = 2 * sums > np.bincount(text, minlength=len(texts))[:, None]
    return np.packbits(ones, axis=1).view(">u8").astype(np.uint64).reshape(-1)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint) per row; the fingerprint is the signed number of the same 64 bits."""

    def signed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream):
            values = fingerprints(texts, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([rest.column("doc_id").combine_chunks(), pa.array(values)], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, signed, "doc_id long, fingerprint long")


def _segment(value: Column, index: Column, width: int) -> Column:
    """Bits of segment ``index`` of ``value``, above them the index."""
    bits = F.call_function("shiftrightunsigned", value, index * width).bitwiseAND(F.lit((1 << width) - 1))
    return bits + index.cast("long") * (1 << width)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def filed(nodes: DataFrame) -> DataFrame:
    """(key, fingerprint, filed): a row under both segments, and one for each segment with a set bit cleared."""
    own = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda s: F.struct(_segment(F.col("fingerprint"), s, SEGMENT).alias("key"), F.lit(True).alias("filed")))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.col("fingerprint").bitwiseAND(_bit(b)) != 0)
    cleared = F.transform(
        set_bits,
        lambda b: F.struct(
            (_segment(F.col("fingerprint"), F.floor(b / SEGMENT).cast("int"), SEGMENT) - _bit(b % SEGMENT)).alias("key"), F.lit(False).alias("filed")
        ),
    )
    return nodes.select("fingerprint", F.explode(F.concat(own, cleared)).alias("at")).select("at.key", "fingerprint", "at.filed")


def split_crowds(rows: DataFrame, nodes: DataFrame, crowd: int) -> DataFrame:
    """``rows`` with ``sub``: null, or in a crowded bucket a key of the second index, over the other segment's halves."""
    places = nodes.select(F.explode(F.array(*[_segment(F.col("fingerprint"), F.lit(s), SEGMENT) for s in (0, 1)])).alias("key"))
    crowded = stored(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("key"), "crowds")
    marked = rows.join(crowded.withColumn("crowd", F.lit(True)), "key", "left")
    other = F.when(F.col("key") < (1 << SEGMENT), F.call_function("shiftrightunsigned", F.col("fingerprint"), F.lit(SEGMENT))).otherwise(
        F.col("fingerprint").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    )
    at = lambda sub, is_filed: F.struct(sub.alias("sub"), F.lit(is_filed).alias("filed"))
    halves = F.sequence(F.lit(0), F.lit(1))
    exact = lambda is_filed: F.transform(halves, lambda h: at(_segment(other, h, HALF), is_filed))

    def flipped(b: Column) -> Column:
        return at(_segment(other, F.floor(b / HALF).cast("int"), HALF).bitwiseXOR(_bit(b % HALF)), False)

    ball = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), flipped)
    spread = F.when(F.col("filed"), F.concat(exact(True), ball)).otherwise(F.concat(exact(False), ball))
    plain = F.array(F.struct(F.lit(None).cast("long").alias("sub"), F.col("filed").alias("filed")))
    places = F.explode(F.when(F.col("crowd"), spread).otherwise(plain)).alias("at")
    return marked.select("key", "fingerprint", places).select("key", "at.sub", "fingerprint", "at.filed")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it is linked with) of the links (a, b), for all nodes but the least ones."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[left], label[right]
        apart = one != two
        if not apart.any():
            break
        left, right, one, two = left[apart], right[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Links:
    """Links found in one task, folded into a forest whenever there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(forest(a, b))
            self.size += len(self.parts[-1][0])
            if self.size > max(PAIRS, 2 * len(self.parts[0][0])):
                self.parts = [self.all()]
                self.size = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return forest(*[np.concatenate(side) for side in zip(*self.parts, strict=True)])


def compare(buckets: np.ndarray, prints: np.ndarray, is_filed: np.ndarray, links: Links) -> None:
    """Compare in each run of equal ``buckets`` the filed fingerprints with all."""
    cuts = np.nonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))[0]
    sizes = np.diff(np.append(cuts, len(buckets)))
    begin, size = np.repeat(cuts, sizes), np.repeat(sizes, sizes)
    rows = np.nonzero(is_filed & (size > 1))[0]
    ends = np.cumsum(size[rows])
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = rows[at:upto]
        left = np.repeat(some, size[some])
        right = np.arange(len(left)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + begin[left]
        one, two = prints[left], prints[right]
        close = (np.bitwise_count(one ^ two) <= DISTANCE) & (one != two)
        links.add(one[close], two[close])
        at = upto


def linked_in_buckets(rows: DataFrame) -> DataFrame:
    """(a, b): a forest of links per task of ``rows`` (key, sub, fingerprint, filed)."""

    def linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        held: list[np.ndarray] = []
        for batch in stream:
            get = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
            lines = np.stack([get("key"), get("sub"), get("fingerprint"), get("filed").astype(np.int64)])
            if not lines.shape[1]:
                continue
            last = lines[:2, -1:]
            # The batch's last bucket may go on in the next batch.
            whole = lines.shape[1] - int(np.argmax((lines[:2, ::-1] != last).any(axis=0))) if (lines[:2] != last).any() else 0
            if whole or (held and (held[-1][:2, -1:] != last).any()):
                _judge([*held, lines[:, :whole]], links)
                held = []
            held.append(lines[:, whole:])
        _judge(held, links)
        nodes, least = links.all()
        yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(nodes.view(np.int64))], names=["a", "b"])

    together = rows.withColumn("sub", F.coalesce("sub", F.lit(-1))).repartition("key", "sub").sortWithinPartitions("key", "sub")
    return in_arrow(together.select("key", "sub", "fingerprint", "filed"), linked, "a long, b long")


def _judge(held: list[np.ndarray], links: Links) -> None:
    lines = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
    if lines.shape[1]:
        cuts = np.concatenate([[True], (lines[:2, 1:] != lines[:2, :-1]).any(axis=0)])
        compare(np.cumsum(cuts), lines[2].view(np.uint64), lines[3].astype(bool), links)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``: the smallest doc_id of the rows it is linked with.

    ``doc_id`` must be whole numbers.  A-Z count as lower case, words are what lies between blanks.  A null or empty text
    and one of blanks have the fingerprint zero and are linked like any other; a text of fewer words is one shingle.
    Rows without a doc_id take part by their text and name no component; one linked with none that has a doc_id gets
    null.  Rows with equal fingerprints belong together, so repeated rows stay and agree.  Further columns are ignored.
    """
    signed = stored(sign(docs, words), "fingerprints")
    nodes = stored(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    forests = linked_in_buckets(split_crowds(filed(nodes), nodes, crowd))
    found = components(stored(forests, "links")).withColumnRenamed("node", "fingerprint")
    known = nodes.join(found, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "component").select("fingerprint", "component_id")
    return signed.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
