"""What the operators share: written tables, ASCII lower case, bytes and word hashes of a batch of texts.

Every operator takes rows that may hold nulls, empty or very long texts, repeated rows and further columns; further
columns are ignored or carried as its docstring says.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import shared_folder

# Bytes of text that one Python task holds at a time; one longer text is held alone.
BATCH_BYTES = 1 << 20
ARROW_BYTES = 4 << 20

_RANDOM = np.random.default_rng(20240607)
BYTE_CODES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = 255  # follows each text in a batch; UTF-8 never has this byte


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows are fixed, and lost executors cost a re-read."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """``rows.mapInArrow`` with batches that fit a small worker however long the texts: the session's limit is lowered
    to ARROW_BYTES if it is higher."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(conf.get(name).removesuffix("b"))
    if size <= 0 or size > ARROW_BYTES:
        conf.set(name, f"{ARROW_BYTES}b")
    return rows.mapInArrow(function, schema)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def powers(base: np.uint64, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {"up": powers(BASE, 1), "down": powers(BASE_INVERSE, 1)}


def _powers(which: str, count: int) -> np.ndarray:
    if len(_POWERS[which]) < count:
        _POWERS[which] = powers(BASE if which == "up" else BASE_INVERSE, count)
    return _POWERS[which][:count]


class Hasher:
    """Hashes of substrings of a byte array in constant time each, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        terms = BYTE_CODES[data]
        terms *= _powers("up", len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, dtype=np.uint64, out=self.prefix[1:])
        self.undo = _powers("down", len(data) + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        values = (self.prefix[ends] - self.prefix[starts]) * self.undo[starts]
        values += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(values)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        count = max(0, len(self.prefix) - size)
        return mixed((self.prefix[size:] - self.prefix[:count]) * self.undo[:count])


class Texts:
    """A batch of texts as one byte array, each followed by END; ``starts`` has one more entry than texts."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        end = bytes([END])
        self.data = np.frombuffer(end.join(texts) + end if texts else b"", dtype=np.uint8)

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, number of words before each text and in all) of the runs of bytes marked in ``inside``."""
        edges = np.diff(inside[self.data].astype(np.int8), prepend=np.int8(0))
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        return starts, ends, np.searchsorted(starts, self.starts)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks the bytes in ``ranges``, both ends included."""
    marks = np.zeros(256, dtype=bool)
    for first, last in ranges:
        marks[first : last + 1] = True
    return marks


# Words between blanks, and words of ASCII letters, digits and all characters beyond ASCII.
UNBLANK = byte_set((0, 8), (14, 31), (33, 254))
ALPHANUMERIC = byte_set((48, 57), (97, 122), (128, 254))


def batches(stream: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES, column: str = "text") -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows in portions of about ``limit`` bytes of ``column``: the other columns, and the texts, empty for null."""
    parts, texts, size = [], [], 0
    for batch in stream:
        own = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        rest = batch.drop_columns([column])
        begin = 0
        for i, text in enumerate(own):
            size += len(text) + 1
            if size >= limit:
                parts.append(rest.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(parts), texts + own[begin : i + 1]
                parts, texts, begin, size = [], [], i + 1, 0
        if begin < len(own):
            parts.append(rest.slice(begin))
            texts = texts + own[begin:]
    if parts:
        yield pa.Table.from_batches(parts), texts


def runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(key, where) of the runs of equal values in ``keys``."""
    cuts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])[0].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)][: len(cuts)], strict=True):
        yield int(keys[a]), slice(a, b)
