"""Substring dedup with repeated-phrase automata over words.

A document's windows of `WINDOW` words are anchored at phrases of `PHRASE` words. In a shard (see
stretches.py) the phrases that recur are confirmed word by word and compiled into an Aho-Corasick
automaton over word numbers; every stretch of every document that reaches the shard is streamed
through it. Around each occurrence the windows are compared word by word, and all but the
earliest are removed.

Null and empty texts and texts with fewer than `WINDOW` words lose nothing. Ties: see stretches.py.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from conductrisk.llm import kernels as K
from conductrisk.llm.rows import sha256, text_of
from conductrisk.llm.stretches import Plan, Stretch, deduplicated

WINDOW, PHRASE = 20, 5


def _tokens(data: np.ndarray, offsets: np.ndarray):
    words = K.words_of(data, offsets)
    raw = data.tobytes()
    start, end = words.start, words.end

    def text(first: int, last: int) -> bytes:
        return b" ".join(raw[start[first]:end[last - 1]].split())

    return words.hashes(), words.of_text, text


def automaton_of(phrases: list[tuple[int, ...]]) -> ahocorasick.Automaton | None:
    """Finds all of the phrases (sequences of word numbers) in one pass over a sequence."""
    if not phrases:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        automaton.add_word(phrase)
    automaton.make_automaton()
    return automaton


def settle(stretches: list[Stretch]) -> list[np.ndarray]:
    """For each stretch, which of its windows start earlier in another one."""
    numbers: dict[bytes, int] = {}
    words = [tuple(numbers.setdefault(w, len(numbers)) for w in x.text.split(b" ")) for x in stretches]
    seen: dict[tuple[int, ...], int] = {}
    for x, sequence in zip(stretches, words, strict=True):
        phrase = sequence[x.at:x.at + PHRASE]
        seen[phrase] = seen.get(phrase, 0) + x.copies
    automaton = automaton_of([phrase for phrase, n in seen.items() if n > 1])
    located: list[set[int]] = []
    earliest: dict[tuple[int, ...], tuple[int, int]] = {}
    for x, sequence in zip(stretches, words, strict=True):
        starts: set[int] = set()
        for last, _ in automaton.iter(sequence) if automaton else ():
            starts.update(range(max(0, last - WINDOW + 1), min(x.count - 1, last - PHRASE + 1) + 1))
        located.append(starts)
        for o in starts:
            window, place = sequence[o:o + WINDOW], (x.place[0], x.place[1] + o)
            if place < earliest.setdefault(window, place):
                earliest[window] = place
    masks = []
    for x, sequence, starts in zip(stretches, words, located, strict=True):
        later = np.zeros(x.count, bool)
        for o in starts:
            later[o] = earliest[sequence[o:o + WINDOW]] != (x.place[0], x.place[1] + o)
        masks.append(later)
    return masks


def _window_text(text: bytes, number: int) -> bytes:
    return b" ".join(text.split(b" ")[number:number + WINDOW])


PLAN = Plan(WINDOW, PHRASE, _tokens, settle, _window_text)


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """`row`, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by blanks; if asked for)."""
    fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]

    def work(batch, removed):
        data, offsets = K.buffer_of(text_of(batch))
        words = K.words_of(data, offsets)
        gone = removed(words.of_text)
        raw, kept = data.tobytes(), []
        for i, (a, b) in enumerate(zip(words.of_text[:-1], words.of_text[1:], strict=True)):
            mine = raw[offsets[i]:offsets[i + 1]].split()
            if gone[a:b].any():
                mine = [w for w, g in zip(mine, gone[a:b].tolist(), strict=True) if not g]
            kept.append(b" ".join(mine))
        out = [words.counts(), K.sums(gone.astype(np.int64), words.of_text),
               pa.array([sha256(x) for x in kept], pa.string())]
        return out + ([pa.array([x.decode() for x in kept], pa.string())] if with_text else [])

    if with_text:
        fields.append(("kept", T.StringType()))
    return deduplicated(docs, PLAN, work, fields)
