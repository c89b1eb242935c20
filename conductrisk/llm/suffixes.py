"""Suffix-array dedup over bytes: suffixes are ordered through `WINDOW` bytes only.

In a shard (see stretches.py) the suffixes that may have an equal are sorted by most-significant-
digit passes: eight bytes a pass, within the groups that the passes before left equal, and groups
of one drop out. After the last pass the groups that are left are exactly the repeated windows;
all members but the earliest are removed.

Null and empty texts and texts with fewer than `WINDOW` bytes lose nothing. Texts are bytes here:
what is kept need not be valid UTF-8. Ties: see stretches.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import sha256, text_of
from conductrisk.llm.stretches import Plan, Stretch, deduplicated

WINDOW, PHRASE = 100, 28
#: Bytes in a digit of the sort.
DIGIT = 8

_VALUES = K.mix(np.arange(1, 257, dtype=np.uint64))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    raw = data.tobytes()
    return _VALUES[data], offsets, lambda first, last: raw[first:last]


def radix_groups(data: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes (places in data) through `length` bytes, within the given groups.

    Returns the indices of the suffixes that have an equal, ordered by group, and their groups.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for i in range(DIGIT):
        digits = (digits << np.uint64(8)) | padded[i:i + len(data)]
    index = np.arange(len(suffixes))
    for depth in range(0, length, DIGIT):
        digit = digits[suffixes[index] + depth]
        if length - depth < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - (length - depth)))
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        fresh = np.ones(len(index), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)
        index, group = index[~alone], group[~alone]
        if not len(index):
            break
    return index, group


def settle(stretches: list[Stretch]) -> list[np.ndarray]:
    """For each stretch, which of its windows start earlier in another one."""
    counts = np.array([x.count for x in stretches], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    base = np.cumsum([0, *(len(x.text) for x in stretches)])[:-1]
    data = np.frombuffer(b"".join([x.text for x in stretches]), np.uint8)
    owner = np.repeat(np.arange(len(stretches)), counts)
    number = np.arange(bounds[-1]) - bounds[:-1][owner]
    # the first pass runs over whole anchors: equal windows hold the same anchor at the same place
    index, group = radix_groups(data, base[owner] + number, np.zeros(bounds[-1], np.int64), WINDOW)
    document = np.array([x.place[0] for x in stretches], np.int64)[owner[index]]
    start = np.array([x.place[1] for x in stretches], np.int64)[owner[index]] + number[index]
    order = np.lexsort((start, document, group))
    index, group, document, start = index[order], group[order], document[order], start[order]
    first = np.searchsorted(group, group)  # rows of one id may share a place: neither is earlier then
    later = np.zeros(bounds[-1], bool)
    later[index[(document != document[first]) | (start != start[first])]] = True
    return [later[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _window_text(text: bytes, number: int) -> bytes:
    return text[number:number + WINDOW]


PLAN = Plan(WINDOW, PHRASE, _tokens, settle, _window_text)


def dedup(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """`row`, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay; if asked for)."""
    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()),
              ("kept_sha256", T.StringType())]

    def work(batch, removed):
        data, offsets = K.buffer_of(text_of(batch))
        gone = removed(offsets)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
        opens[firsts] |= gone[firsts]
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        out = [np.diff(offsets), K.sums(gone.astype(np.int64), offsets), K.sums(opens.astype(np.int64), offsets),
               pa.array([sha256(x) for x in kept], pa.string())]
        return out + ([pa.array(kept, pa.binary())] if with_bytes else [])

    if with_bytes:
        fields.append(("kept", T.BinaryType()))
    return deduplicated(docs, PLAN, work, fields)
