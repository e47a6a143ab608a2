"""Two-stage suffix sorting of bytes, as far as long common prefixes need it."""

from __future__ import annotations

import numpy as np

from marginalia.llm.common import runs


PORTION = 1 << 19


class Bytes:
    """Bytes that can be read eight at a time from any place; ``room`` zeros follow."""

    def __init__(self, data: np.ndarray, room: int):
        self.data = np.concatenate([data, np.zeros(room + 8, np.uint8)])
        self.eights = np.ndarray((len(self.data) - 7,), dtype=">u8", buffer=self.data, strides=(1,))

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.eights[places].astype(np.uint64)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Marks the suffixes that are smaller than the one starting a byte later; the last counts as such."""
    marks = np.ones(len(data), bool)
    end = len(data) - 1
    while end > 0:  # portions from the end, so that runs of one byte take the mark of what follows them
        begin = max(0, end - PORTION)
        part = data[begin : end + 1]
        changes = np.nonzero(part[:-1] != part[1:])[0]
        rises = np.concatenate([part[changes] < part[changes + 1], marks[end : end + 1]])
        marks[begin:end] = rises[np.searchsorted(changes, np.arange(end - begin))]
        end = begin
    return marks


def sort_directly(text: Bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the ``depth`` bytes (rounded up to eights) that start there; further bytes only break ties."""
    key = text.at(places)
    order = places[by := np.argsort(key)]
    key = key[by]
    head = np.concatenate([[True], key[1:] != key[:-1]])[: len(places)]
    for begin in range(8, depth, 8):
        last = np.concatenate([head[1:], [True]])[: len(head)]
        tied = np.nonzero(~(head & last))[0]
        if not len(tied):
            break
        group, members = np.cumsum(head[tied]), order[tied]
        key = text.at(members + begin)
        by = np.lexsort((key, group))
        order[tied], key = members[by], key[by]
        head[tied[1:]] |= key[1:] != key[:-1]
    return order


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in ``wanted`` in the order of their suffixes, exact for the first ``depth`` bytes.

    First stage: the suffixes smaller than their successors are sorted directly.  Second stage: all others start
    with a byte followed by a smaller suffix, so one scan over the buckets of first bytes, from the smallest, meets
    their successors in order and puts each behind those already in its bucket.  ``data`` must end with byte 255.
    """
    text = Bytes(data, depth + 16)
    small = smaller_than_next(data)
    sought = np.zeros(len(data) + 1, bool)
    sought[wanted] = True
    fresh = wanted
    while len(fresh):  # a successor is needed to place a suffix of the second stage
        fresh = fresh[~small[fresh]] + 1
        fresh = fresh[~sought[fresh]]
        sought[fresh] = True
    sought = sought[:-1]
    direct = sort_directly(text, np.nonzero(sought & small)[0], depth)
    first = data[direct]
    begins = np.searchsorted(first, np.arange(257))
    later = sought & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done: list[np.ndarray] = []
    for byte in range(256):
        parts = waiting[byte]
        level = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):  # runs of this byte
            before = level - 1
            before = before[before >= 0]
            level = before[later[before] & (data[before] == byte)]
            bucket.append(level)
        bucket.append(direct[begins[byte] : begins[byte + 1]])
        whole = np.concatenate(bucket)
        done.append(whole)
        before = whole[whole > 0] - 1
        before = before[later[before]]
        letters = data[before]
        before, letters = before[letters > byte], letters[letters > byte]
        by = np.argsort(letters, kind="stable")
        before, letters = before[by], letters[by]
        for letter, part in runs(letters):
            waiting[letter].append(before[part])
    order = np.concatenate(done)
    chosen = np.zeros(len(data), bool)
    chosen[wanted] = True
    return order[chosen[order]]


def shared_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Marks the suffixes in ``order`` that have ``length`` (at least 8) bytes in common with the one before."""
    text = Bytes(data, length + 16)
    same = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for begin in [*range(0, length - 7, 8), length - 8]:
        left = left[text.at(order[left] + begin) == text.at(order[left - 1] + begin)]
    same[left] = True
    return same
