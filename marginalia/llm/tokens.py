"""Token ids of whole texts, and the pieces documents are cut into for packing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import batches, in_arrow

CACHED = 600_000
JOINED = 1000

# The form of tokenizer file the short way below knows: fixed values.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# The same split for lower-case characters up to U+012F, and the texts it is used for: those are left as they are by
# NFC, and blanks are those of str.split().
_L, _N = "a-zªµºß-öø-ÿĀ-į", "0-9²³¹¼-¾"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
UNUSUAL = re.compile("[^\t-\r -~\xa1-į]|<\\|")


class Encoder:
    """Token ids as little-endian 32-bit numbers, equal to the tokenizer's own without special tokens.

    Ids of blank-separated parts are remembered, as no token crosses a blank.  Texts with characters beyond U+012F,
    control characters or the look of special tokens, and other forms of tokenizer, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.whole = Tokenizer.from_file(path)
        parts = (form.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        known = form.get("normalizer") == NORMALIZER and parts[0].get("pattern") == {"Regex": SPLIT} and len(parts) == 2
        self.short = known and parts[1].get("type") == "ByteLevel" and not form.get("post_processor")
        self.word = Tokenizer(self.whole.model)
        self.word.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.short:
            return [self._whole(t) for t in texts]
        usual = [UNUSUAL.search(t) is None for t in texts]
        split = [t.lower().split() if u else [] for t, u in zip(texts, usual, strict=True)]
        self._learn(split)
        get = self.parts.__getitem__
        return [b"".join(map(get, s)) if u else self._whole(t) for t, u, s in zip(texts, usual, split, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, split: list[list[str]]) -> None:
        """Make sure every part has its ids; what is remembered is dropped when it has grown too large."""
        if len(self.parts) > CACHED:
            self.parts.clear()
        if len(self.words) > CACHED:
            self.words.clear()
        fresh = list(set(chain.from_iterable(split)).difference(self.parts))
        found = list(map(WORDS.findall, fresh))
        unknown = list(set(chain.from_iterable(found)).difference(self.words))
        for begin in range(0, len(unknown), JOINED):
            group = unknown[begin : begin + JOINED]
            encoding = self.word.encode(" ".join(group), add_special_tokens=False)
            ids, owner = np.asarray(encoding.ids, dtype="<u4"), np.asarray(encoding.word_ids)
            cuts = (np.searchsorted(owner, np.arange(len(group) + 1)) * 4).tolist()
            raw = ids.tobytes()
            self.words.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        words = self.words
        self.parts.update(zip(fresh, [words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws]) for ws in found], strict=True))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, ids: bool = False) -> DataFrame:
    """A row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Only documents longer
    than ``capacity`` are cut.  ``tokenizer`` is a file every executor has.  Repeated rows give repeated pieces;
    further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for rest, texts in batches(stream):
            row, piece, start, length, crc, values = [], [], [], [], [], []
            for i, raw in enumerate(encoder.encode([t.decode() for t in texts])):
                whole = memoryview(raw + end)
                for number, begin in enumerate(range(0, len(whole), step)):
                    part = whole[begin : begin + step]
                    row.append(i)
                    piece.append(number)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        values.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            owner = rest.column("doc_id").combine_chunks().take(pa.array(row, pa.int64()))
            columns = [owner, pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            if ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return in_arrow(docs.select("doc_id", docs["text"].cast("string").alias("text")), cut, wanted)
