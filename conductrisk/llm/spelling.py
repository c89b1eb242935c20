"""Spelling variants: words at edit distance one, found by pivotal grams, and grouped by how common they are.

All words get their bigrams ordered from rare to common (bigram counts are bounded by the alphabet and broadcast), equal
ones by their place. The prefix of a word are its first three; its pivots are two disjoint bigrams of the prefix with the
smallest total order, chosen by dynamic programming. One edit destroys at most one of two disjoint bigrams, and the ones
that stay keep their order. So if, of two words at distance one, a pivot x of the first stays but is not in the
prefix of the other, all that prefix, and in it a pivot y that stays, comes before x, and so y is in the prefix of the
first. Hence looking up the pivots of each word among the prefixes of all others misses no pair.

Position limits: the edit lies to the left or to the right of the pivot, so the letters on the other side are equal and the
pivot stands equally far from that end. The side with the edit is cut into windows of two letters (of a sixteenth of a word
of more than 32), and all that stands outside the window of the edit is equal, too: pivot, window and the letters outside
form the key of the index. So the words of a list differ in two letters (three of the longer word) only, which bounds lists by
the alphabet even if a bigram is in a third of all words, and nothing is capped. Every candidate is verified by its distance.

Null and empty texts have no words; a null doc_id counts as the empty text. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from conductrisk.llm.kernels import pieces
from conductrisk.llm.rows import broadcast, text_of
from conductrisk.session import stage

#: Least length of a word in code points, least count, one of so many runs loses a letter.
LENGTH, COUNT, DROPPED = 7, 2, 31
#: A word's form must be so many times as common.
FACTOR = 10
#: Edits that are looked for, letters of a gram.
_EDITS, _GRAM = 1, 2
_PREFIX = _GRAM * _EDITS + 1
#: Letters of a window that an edit is looked for in, and most windows of a word.
WINDOW, _WINDOWS = 2, 16
#: Words with more letters are long.
_LONG = 64
#: Bytes of text and of words in a block, distinct words that a task counts before it hands them on.
BLOCK_BYTES, WORD_BYTES, _FLUSH = 1_000_000, 50_000, 200_000
_PLAIN, _WIDE = re.compile("[a-z]+"), re.compile("[a-zÀ-ÿ]+")


def _runs(text: str, least: int) -> Counter:
    """Maximal runs of letters, A-Z lowered, with their counts; at least `least` code points."""
    lowered = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    found = _PLAIN.findall(lowered.decode()) if lowered.isascii() else _WIDE.findall(lowered.decode("utf-8", "surrogatepass"))
    return Counter(x for x in found if len(x) >= least)


def _altered(run: str, seed: int, dropped: int) -> str:
    """The run, or the run without one letter; `seed` is the crc32 of what precedes the run."""
    h = zlib.crc32(run.encode(), seed)
    if h % dropped:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame, least: int = LENGTH, count: int = COUNT, dropped: int = DROPPED) -> DataFrame:
    """word and n: the words of all whole texts with at least `count` occurrences."""
    rows = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").alias("row"))

    def counted(batches):
        total: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()

        for batch in batches:
            texts, ids = text_of(batch), pc.struct_field(batch.column("row"), "doc_id")
            for at, size in pieces(texts, BLOCK_BYTES):
                for doc_id, text in zip(ids.slice(at, size).to_pylist(), texts.slice(at, size).to_pylist(), strict=True):
                    seed = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in _runs(text or "", least).items():
                        word = _altered(run, seed, dropped)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > _FLUSH:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _word_blocks(batches):
    for batch in batches:
        words = batch.column("word")
        for at, size in pieces(words, WORD_BYTES):
            yield words.slice(at, size).to_pylist()


def gram_order(vocabulary: DataFrame) -> dict[str, int]:
    """Place of each bigram, rare ones first. There are at most 90 x 90 of them (26 letters and 64 accented ones)."""
    def counted(batches):
        total: Counter = Counter()
        for words in _word_blocks(batches):
            for word in words:
                total.update(word[i:i + _GRAM] for i in range(len(word) - _GRAM + 1))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(total.keys(), pa.string()), "c": pa.array(total.values(), pa.int64())})

    counts = vocabulary.select("word").mapInArrow(counted, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")).collect()
    return {x["gram"]: i for i, x in enumerate(sorted(counts, key=lambda x: (x["c"], x["gram"])))}


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order, place) of the three rarest bigrams, equal ones from the left."""
    return nsmallest(_PREFIX, ((order[word[i:i + _GRAM]], i) for i in range(len(word) - _GRAM + 1)))


def pivots_of(prefix: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two disjoint bigrams of the prefix with the least sum of orders, by dynamic programming over the places; fewer if
    there are none."""
    need = _EDITS + 1
    by_place = sorted(prefix, key=lambda x: x[1])
    # best[k]: (sum, chosen) of k disjoint grams that end before the place in hand; `waiting` may still overlap it
    best: list[tuple[int, tuple]] = [(0, ())] + [None] * need
    waiting: list[tuple[int, int, tuple[int, tuple]]] = []
    for gram in by_place:
        ready = [x for x in waiting if x[0] <= gram[1]]
        waiting = [x for x in waiting if x[0] > gram[1]]
        for _, k, option in ready:
            if best[k] is None or option < best[k]:
                best[k] = option
        for k in range(need):
            if best[k] is not None:
                waiting.append((gram[1] + _GRAM, k + 1, (best[k][0] + gram[0], (*best[k][1], gram))))
    for _, k, option in waiting:
        if best[k] is None or option < best[k]:
            best[k] = option
    return list(next((x[1] for x in reversed(best) if x is not None), ()))


def keys_of(word: str, place: int) -> list[int]:
    """Keys of the word by its bigram at `place`: two words at distance one that share it unchanged share a key.

    The word is the shorter one or as long as the other, or the longer one; the edit is on either side of the bigram, in
    one of the windows of the shorter word. The key is all that stands outside the window.
    """
    n, letters, out = len(word), word.encode("utf-32-le", "surrogatepass"), []
    for short in (n, n - 1):
        for side, start, stop in ((0, place + _GRAM, short), (1, 0, place - (n - short))):  # places in the shorter word
            if stop < start:
                continue
            width = max(WINDOW, -(-short // _WINDOWS))
            tag = (short << 1 | side).to_bytes(4, "little") + (place if side == 0 else n - place).to_bytes(4, "little")
            for at in range(start, max(stop, start + 1), width):
                behind = short - min(at + width, stop)  # letters behind the window, counted from the end
                out.append(xxh3_64_intdigest(tag + at.to_bytes(4, "little") + letters[:4 * at] + letters[4 * (n - behind):]))
    return out


def _index(vocabulary: DataFrame, order: dict[str, int]) -> DataFrame:
    """key, word and pivot (whether the key is of a pivot) for each prefix bigram."""
    shared = broadcast(vocabulary.sparkSession, order)

    def listed(batches):
        order = shared.value
        for words in _word_blocks(batches):
            keys, names, kinds = [], [], []
            for word in words:
                prefix = prefix_of(word, order)
                chosen = set(pivots_of(prefix))
                for gram in prefix:
                    own = keys_of(word, gram[1])
                    keys.extend(own)
                    names.extend([word] * len(own))
                    kinds.extend([gram in chosen] * len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(names, pa.string()), pa.array(kinds, pa.bool_())],
                ["key", "word", "pivot"])

    return vocabulary.select("word").mapInArrow(listed, "key long, word string, pivot boolean")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether different words are at edit distance one. The built-in distance is for short words; of long ones, all behind
    the first difference must be equal."""
    letters = lambda w: F.split(w, "")
    at = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    rest = lambda w, other: F.substring(w, at + F.when(F.length(w) < F.length(other), 0).otherwise(1), F.length(w))
    longer = (F.abs(F.length(a) - F.length(b)) <= _EDITS) & (rest(a, b) == rest(b, a))
    return F.when(F.length(a) > _LONG, longer).otherwise(F.levenshtein(a, b, _EDITS) == _EDITS)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b): all pairs at edit distance one, each once. `vocabulary` has distinct words.

    Both sides of the join are the same shuffle of the index: which of them asks with a pivot is part of its condition.
    """
    listed = _index(vocabulary, gram_order(vocabulary))
    a, b = listed.alias("a"), listed.alias("b")
    # where both ask, they would meet twice
    asks = F.when(F.col("b.pivot"), F.col("a.word") < F.col("b.word")).otherwise(F.col("a.word") != F.col("b.word"))
    # the distance comes last, as it costs most, and is not asked for where the rest is null; the index is larger than its
    # source, so no side may be broadcast
    near = F.coalesce(F.when(F.col("a.pivot"), asks), F.lit(False)) & _one_edit(F.col("a.word"), F.col("b.word"))
    found = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & near)
    return found.select(F.least("a.word", "b.word").alias("a"), F.greatest("a.word", "b.word").alias("b")).distinct()


def grouped(docs: DataFrame, factor: int = FACTOR, least: int = LENGTH, count: int = COUNT, dropped: int = DROPPED) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    if factor < 2 or least < _GRAM * (_EDITS + 1):
        raise ValueError("forms need a factor of 2 at least, and words room for two disjoint bigrams")
    vocabulary = stage(words(docs, least, count, dropped), "words")
    directions = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                         F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    pairs = near_words(vocabulary).select(F.explode(directions).alias("p")).select("p.*")
    known = pairs.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the most common near word; of equal ones the first in the order of its UTF-8 bytes, which is that of code points
    best = known.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    common = -F.col("best.neg") >= factor * F.col("n")
    formed = stage(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.neg")).alias("form_n")), "forms")
    return formed.join(_roots(formed), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(formed: DataFrame) -> DataFrame:
    """word and root of the words with a form. Counts grow `factor` times with each step, so few rounds of doubling do."""
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage(links.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")
