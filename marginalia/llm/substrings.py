"""Removal of long repeated substrings by suffix arrays (operator 8).

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id.

Sorting all suffixes of the corpus would move every suffix with its ``length`` bytes.  So places are found first where
a repetition is possible at all, and only text around them is sorted:

1. Every window of ``length`` bytes has an anchor, the gram of GRAM bytes in it with the least hash; equal windows have
   equal anchors.  Anchors are counted over the corpus (one number per batch and anchor, in arrays, is shuffled).  A
   window whose anchor occurs in one document only occurs there only.
2. The windows of repeated anchors are cut out as pieces, one per run of windows with the same anchor.  Within a home,
   the documents of one task, equal pieces are settled at once and only the smallest doc_id's is sent on.  Pieces meet
   in the task of their anchor.  There a suffix array of the windows is built by two-stage sorting and windows with a
   common prefix of ``length`` bytes are grouped; all but those of the smallest doc_id are repetitions.
3. The marked spans return to the documents' homes, where they are joined and cut out.

Anchors of very many documents are hot: their windows are sent one by one to the task of the window's own hash, so no
task holds the surroundings of all their places.  The number of hot anchors is bounded by HOT_ANCHORS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import END, Hasher, Texts, batches, in_arrow, runs, stored
from marginalia.llm.suffixes import shared_prefix, suffix_order

LENGTH = 50
GRAM = 20
HOT_ANCHORS = 50_000
LEAST_HOT = 5_000
HOME_BYTES, COUNT_BYTES, SORT_BYTES = 8 << 20, 32 << 20, 2 << 20
PORTION = 1 << 20
TASKS = 4096


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive items of about ``limit`` in sum."""
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, "right")))
        yield begin, end
        begin = end


class Windows:
    """Runs of windows with the same anchor in a batch: first and last window, text and hash of the anchor."""

    def __init__(self, texts: list[bytes], length: int):
        self.batch, self.length = Texts(texts), length
        found = [self._runs(a, b) for a, b in _portions(np.diff(self.batch.starts), PORTION)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.first, self.last, self.hash = (np.concatenate(c) for c in zip(none, *found, strict=True))
        self.text = np.searchsorted(self.batch.starts, self.first, "right") - 1

    def _runs(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts from ``low`` to ``high``."""
        starts = self.batch.starts[low : high + 1]
        data = self.batch.data[starts[0] : starts[-1]]
        begin, end = starts[:-1] - starts[0], starts[1:] - starts[0] - 1 - self.length
        fits = end >= begin
        if not fits.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = Hasher(data).grams(GRAM)
        places = np.uint64((1 << 31) - 1)
        least = (grams & ~places) | np.arange(len(grams), dtype=np.uint64)
        width, reach = self.length - GRAM + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        marks = np.zeros(len(data) + 1, np.int8)
        marks[begin[fits]] += 1
        marks[end[fits] + 1] -= 1
        windows = np.nonzero(np.cumsum(marks, dtype=np.int8))[0]
        anchors = (least[windows] & places).astype(np.int64)
        cut = np.nonzero((np.diff(windows, prepend=-2) != 1) | (np.diff(anchors, prepend=-1) != 0))[0]
        last = windows[np.concatenate([cut[1:] - 1, [len(windows) - 1]])]
        return windows[cut] + starts[0], last + starts[0], grams[anchors[cut]]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - first
    result = np.empty(len(first), np.uint64)
    for a, b in _portions(sizes, PORTION):
        edges = np.concatenate([[0], np.cumsum(sizes[a:b])])
        place = np.arange(edges[-1]) + np.repeat(first[a:b] - edges[:-1], sizes[a:b])
        result[a:b] = Hasher(data[place]).spans(edges[:-1], edges[1:])
    return result


def duplicate_spans(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, spans (removed runs of bytes, end excluded) and ``kept``, the remaining bytes.

    ``doc_id`` must be whole numbers.  A null text counts as empty.  Rows without a doc_id neither lose nor mark
    anything; rows that share one do not mark each other.  ``length`` is at least 28.  The columns of ``docs`` in
    ``carry``, all by default, are carried, those named like a result replaced.  With ``as_text`` the column ``text``
    holds what remains, without the parts of characters that were cut through, in place of ``kept``.
    """
    result = ["n_bytes", "spans", "text" if as_text else "kept"]
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in result]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.lit(0), *carried).alias("row"), F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    homes, counters, sorters = (int(-(-total // size)) or 1 for size in (HOME_BYTES, COUNT_BYTES, SORT_BYTES))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc", "text"), F.lit(homes)).cast("int"))

    limit = max(LEAST_HOT, total // GRAM // HOT_ANCHORS)
    repeated = stored(_repeated_anchors(rows.filter("doc is not null"), length, counters, limit), "repeated-anchors")
    hot = [r["anchor"] for r in repeated.filter("home is null").select("anchor").collect()]
    hot_anchors = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))
    wanted = repeated.filter("home is not null").select("home", "anchors")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _pieces(left, right, length, hot_anchors.value, counters, sorters)

    pieces = rows.groupBy("home").cogroup(wanted.groupBy("home")).applyInArrow(cut, PIECES)
    spans = in_arrow(dealt(pieces, sorters, "sorter"), lambda stream: _sorted_spans(stream, length), SPANS)

    added = "n_bytes long, spans array<struct<start:long,end:long>>, " + ("text string" if as_text else "kept binary")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(added)])
    carry_table = lambda left, right: _remaining(left, right, as_text)
    done = rows.groupBy("home").cogroup(spans.groupBy("home")).applyInArrow(carry_table, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in carried], *result)


# --- 1: anchors in more than one text

COUNTED = "counter int, home int, homes array<int>, low array<int>, texts array<int>, anchors array<long>"
REPEATED = "home int, anchors array<long>, anchor long, texts long"


def _short(anchors: np.ndarray, counters: int) -> np.ndarray:
    """What an anchor is known by: its counter and half of its hash."""
    return ((anchors >> np.uint64(32)) % np.uint64(counters) << np.uint64(32)) | (anchors & np.uint64(0xFFFFFFFF))


def _repeated_anchors(rows: DataFrame, length: int, counters: int, limit: int) -> DataFrame:
    """Rows (home, anchors) to look for, and rows (anchor, texts) for the anchors of many texts."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream, HOME_BYTES // 2):
            windows = Windows(texts, length)
            anchor, text = _short(windows.hash, counters), windows.text
            home = rest.column("home").to_numpy()[text].astype(np.int64)
            order = np.lexsort((text, anchor))
            anchor, text, home = anchor[order], text[order], home[order]
            fresh = (np.diff(anchor, prepend=~anchor[:1]) != 0) | (np.diff(text, prepend=-1) != 0)
            anchor, home = anchor[fresh], home[fresh]
            first = np.nonzero(np.diff(anchor, prepend=~anchor[:1]))[0]
            n = np.diff(np.concatenate([first, [len(anchor)]]))
            # Each anchor goes to its counter once; texts that share one within the batch know it already.
            lead = anchor[first]
            parts = list(runs((lead >> np.uint64(32)).astype(np.int64)))
            pairs = _pairs(home, anchor, np.repeat(n, n) > 1)
            known = list(runs(pairs[:, 0].astype(np.int64)))
            none = lambda other: [None] * len(other)
            columns = {
                "counter": [c for c, _ in parts] + [h % counters for h, _ in known],
                "home": none(parts) + [h for h, _ in known],
                "homes": [home[first[p]] for _, p in parts] + none(known),
                "low": [lead[p].astype(np.uint32).view(np.int32) for _, p in parts] + none(known),
                "texts": [n[p] for _, p in parts] + none(known),
                "anchors": none(parts) + [pairs[p, 1].view(np.int64) for _, p in known],
            }
            schema = _arrow(COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(stream, "counter"):
            yield from _repeated(batch, limit)

    counted = in_arrow(rows.select("home", "text"), count, COUNTED)
    return in_arrow(dealt(counted, counters, "counter"), gather, REPEATED)


def _repeated(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of REPEATED for one counter; anchors of more than ``limit`` texts get a row of their own."""
    schema = _arrow(REPEATED)
    passed = batch.filter(pc.is_valid(batch.column("home")))
    empty = pa.nulls(passed.num_rows, pa.int64())
    yield pa.RecordBatch.from_arrays([passed.column("home"), passed.column("anchors"), empty, empty], schema=schema)
    lists = list(_lists(batch.filter(pc.is_null(batch.column("home"))), "counter", "low", "homes", "texts"))
    if not lists:
        return
    anchor = np.concatenate([(np.uint64(c) << np.uint64(32)) | low.view(np.uint32).astype(np.uint64) for c, low, _, _ in lists])
    owner, n = (np.concatenate([row[k] for row in lists]) for k in (2, 3))
    order = np.argsort(anchor, kind="stable")
    anchor, owner, n = anchor[order], owner[order].astype(np.int64), n[order].astype(np.int64)
    first = np.nonzero(np.diff(anchor, prepend=~anchor[:1]))[0]
    texts = np.add.reduceat(n, first)
    many = texts > limit
    hot = [pa.nulls(many.sum(), pa.int32()), pa.nulls(many.sum(), pa.list_(pa.int64()))]
    hot += [pa.array(anchor[first[many]].view(np.int64)), pa.array(texts[many])]
    yield pa.RecordBatch.from_arrays(hot, schema=schema)
    all_texts = np.repeat(texts, np.diff(np.concatenate([first, [len(anchor)]])))
    pairs = _pairs(owner, anchor, (all_texts > 1) & (n == 1))
    parts = list(runs(pairs[:, 0].astype(np.int64)))
    found = [pa.array([h for h, _ in parts], pa.int32()), pa.array([pairs[p, 1].view(np.int64) for _, p in parts], pa.list_(pa.int64()))]
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays([*found, none, none], schema=schema)


def dealt(rows: DataFrame, values: int, column: str) -> DataFrame:
    """``rows`` with those of each of ``values`` numbers together; many numbers share a task, one after the other."""
    tasks = values if values <= TASKS else max(TASKS, values // 8)
    return rows.repartition(tasks, column).sortWithinPartitions(column)


def grouped(stream: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``column``, by which the stream is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        for value, part in runs(batch.column(column).to_numpy()):
            if held and held[0].column(column)[0].as_py() != value:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(part.start, part.stop - part.start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs(homes: np.ndarray, anchors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Distinct (home, anchor), sorted."""
    homes, anchors = homes[chosen].astype(np.uint64), anchors[chosen]
    order = np.lexsort((anchors, homes))
    pairs = np.stack([homes[order], anchors[order]], axis=1)
    return pairs[np.concatenate([[True], (np.diff(pairs, axis=0) != 0).any(axis=1)])[: len(pairs)]]


def _lists(batch: pa.RecordBatch, scalar: str, *names: str) -> Iterator[tuple]:
    """Row by row: a number and the arrays of the list columns."""
    for row in range(batch.num_rows):
        yield batch.column(scalar)[row].as_py(), *[batch.column(n)[row].values.to_numpy().copy() for n in names]


# --- 2: pieces of text around them, sorted

PIECES = (
    "sorter int, home int, docs array<long>, rows array<int>, starts array<int>, sizes array<int>, bytes binary, "
    "found_rows array<int>, found_starts array<int>, found_ends array<int>"
)
SPANS = "home int, rows array<int>, starts array<int>, ends array<int>"


def _in_order(left: pa.Table) -> pa.Table:
    """The rows of a home in an order that does not depend on how they came; equal rows are interchangeable."""
    return left.take(pc.sort_indices(left, sort_keys=[("doc", "ascending"), ("text", "ascending")]))


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


def _pieces(left: pa.Table, right: pa.Table, length: int, hot: np.ndarray, counters: int, sorters: int) -> pa.Table:
    schema = _arrow(PIECES)
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    home = left.column("home")[0].as_py()
    left = _in_order(left)
    doc = pc.fill_null(left.column("doc"), 0).to_numpy()
    known = left.column("doc").is_valid().to_pylist()
    windows = Windows([t if k else b"" for t, k in zip(_texts(left), known, strict=True)], length)
    data = windows.batch.data
    wanted = np.concatenate([c.flatten().to_numpy() for c in right.column("anchors").chunks]).view(np.uint64)
    short = _short(windows.hash, counters)
    some = np.isin(short, wanted)
    first, last, row, key, short = (a[some] for a in (windows.first, windows.last, windows.text, windows.hash, short))
    single = np.isin(short, hot)
    if single.any():
        n = np.where(single, last - first + 1, 1)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, last, row, key, alone = (np.repeat(a, n) for a in (first, last, row, key, single))
        first = np.where(alone, first + step, first)
        last = np.where(alone, first, last)
        key[alone] = span_hashes(data, first[alone], first[alone] + length)
    end = last + length
    owner, later = _equal_pieces(data, first, end, doc[row])
    start = first - windows.batch.starts[row]
    columns: dict[str, list] = {name: [] for name in schema.names}

    def add(**values) -> None:
        for name in schema.names:
            columns[name].append(values.get(name))

    if later.any():
        span = {"found_starts": start[later], "found_ends": start[later] + (end - first)[later]}
        add(sorter=home % sorters, home=home, found_rows=row[later], **span)
    sorter = ((key ^ (key >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(20)) % np.uint64(sorters)
    chosen = np.nonzero(owner)[0]
    chosen = chosen[np.argsort(sorter[chosen], kind="stable")]
    packer, mark = zstandard.ZstdCompressor(level=1), bytes([END])
    whole = data.tobytes()
    for to, part in runs(sorter[chosen].astype(np.int64)):
        mine = chosen[part]
        blob = packer.compress(mark.join([whole[a:b] for a, b in zip(first[mine].tolist(), end[mine].tolist(), strict=True)]) + mark)
        sent = {"docs": doc[row[mine]], "rows": row[mine], "starts": start[mine], "sizes": (end - first)[mine]}
        add(sorter=to, home=home, bytes=blob, **sent)
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _equal_pieces(data: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces to send on, pieces equal to one of a smaller doc_id in this home)."""
    owner, later = np.ones(len(first), bool), np.zeros(len(first), bool)
    if not len(first):
        return owner, later
    key = span_hashes(data, first, end)
    order = np.lexsort((doc, key))
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    lead = order[np.nonzero(head)[0]][np.cumsum(head) - 1]
    other = order[doc[order] > doc[lead]]
    lead = lead[doc[order] > doc[lead]]
    sizes = end[other] - first[other]
    alike = sizes == end[lead] - first[lead]
    other, lead, sizes = other[alike], lead[alike], sizes[alike]
    if len(other):
        begins = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        same = data[np.repeat(first[other], sizes) + step] == data[np.repeat(first[lead], sizes) + step]
        equal = np.add.reduceat(same, begins, dtype=np.int64) == sizes
        later[other[equal]] = True
        owner[other[equal]] = False
    return owner, later


def _sorted_spans(stream: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in grouped(stream, "sorter"):
        yield from _repetitions(batch, length)


def _repetitions(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of SPANS for one sorter."""
    schema = _arrow(SPANS)
    passed = batch.filter(pc.is_null(batch.column("bytes")))
    yield pa.RecordBatch.from_arrays([passed.column(n) for n in ("home", "found_rows", "found_starts", "found_ends")], schema=schema)
    sent = batch.filter(pc.is_valid(batch.column("bytes")))
    if not sent.num_rows:
        return
    unpack = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join([unpack.decompress(b) for b in sent.column("bytes").to_pylist()]), dtype=np.uint8)
    lists = list(_lists(sent, "home", "docs", "rows", "starts", "sizes"))
    doc, row, start, size = (np.concatenate([one[k] for one in lists]) for k in range(1, 5))
    home = np.repeat([one[0] for one in lists], [len(one[1]) for one in lists])
    size = size.astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1  # a byte of its own follows each piece
    n = size - length + 1
    piece = np.repeat(np.arange(len(size)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    place = begin[piece] + offset
    order = suffix_order(data, place, length)
    group = np.cumsum(~shared_prefix(data, order, length)) - 1
    number = np.empty(len(data), np.int64)
    number[place] = np.arange(len(place))
    window = number[order]
    owner = doc[piece[window]]
    heads = np.nonzero(np.diff(group, prepend=-1))[0]
    least = np.minimum.reduceat(owner, heads)
    marked = np.zeros(len(place), bool)
    marked[window[owner > least[group]]] = True
    # Runs of marked windows of a piece.
    hit = np.nonzero(marked)[0]
    fresh = (np.diff(hit, prepend=-2) != 1) | (np.diff(piece[hit], prepend=-1) != 0)
    cut = np.nonzero(fresh)[0]
    last = np.concatenate([cut[1:] - 1, [len(hit) - 1]])[: len(cut)]
    owner_piece = piece[hit[cut]]
    span_start = start[owner_piece] + offset[hit[cut]]
    span_end = start[owner_piece] + offset[hit[last]] + length
    span_home, span_row = home[owner_piece], row[owner_piece]
    at = np.argsort(span_home, kind="stable")
    parts = list(runs(span_home[at]))
    values = [[h for h, _ in parts], *[[v[at[p]] for _, p in parts] for v in (span_row, span_start, span_end)]]
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


# --- 3: what remains


def _remaining(left: pa.Table, right: pa.Table, as_text: bool) -> pa.Table:
    left = _in_order(left)
    texts = _texts(left)
    flat = lambda name: np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in right.column(name).chunks]])
    row, start, end = flat("rows"), flat("starts"), flat("ends")
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
        mine = spans[r]
        if mine and a <= mine[-1][1]:
            if b > mine[-1][1]:
                mine[-1] = (mine[-1][0], b)
        else:
            mine.append((a, b))
    kept = [_without(t, s) for t, s in zip(texts, spans, strict=True)]
    last = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    found = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span)
    arrays = [left.column("row").combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), found, last]
    return pa.Table.from_arrays(arrays, names=["row", "n_bytes", "spans", "text" if as_text else "kept"])


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *[e for s in spans for e in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(kinds[inner]) if inner != kind else kinds[kind]))
    return pa.schema(fields)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the remaining text, empty for null, and all other columns as they are."""
    return duplicate_spans(docs, length, as_text=True).select(*docs.columns)
