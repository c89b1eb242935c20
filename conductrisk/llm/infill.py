"""Fill-in-middle: a text is cut twice at borders of units, and its three parts are written in another order.

The code points of a block of texts are mapped to character classes, and a wavelet matrix over the classes answers how
many code points of a class stand before a place. The borders of a unit (`UNITS`: lines, sentences, words, code
points) are counted by summing the ranks of the classes that end it, so a text's number of units takes two sums,
and the place of a cut is found by bisection on the summed ranks, for all texts of the block at once.

Which text is rewritten, where it is cut and how it is ordered follow from the SHA-256 of `seed:doc_id`, so they do not depend
on partitions, order or retries. A null text is empty and, like a text that contains one of the marks,
stays plain; a null doc_id is hashed as the empty text. Rows that repeat are cut alike. A text of one unit is
cut at its ends. Very long texts are blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conductrisk.llm.kernels import pieces
from conductrisk.llm.rows import pack, sha256, text_of
from conductrisk.llm.wavelet import WaveletMatrix

SEED = 7
#: Shares in percent: texts that are rewritten, and those of them with the suffix in front.
REWRITTEN, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes of text in a block.
BLOCK_BYTES = 1_000_000

#: Character classes.
OTHER, LETTER, DIGIT, BLANK, NEWLINE, STOP, PUNCTUATION = range(7)
_CLASS_BITS = 3
#: The classes that end a unit. A unit is a run of other classes with the end behind it, or without one at the text's end.
UNITS = {
    "line": (NEWLINE,),
    "sentence": (NEWLINE, STOP),
    "word": (NEWLINE, BLANK),
    "character": (OTHER, LETTER, DIGIT, BLANK, NEWLINE, STOP, PUNCTUATION),
}


def _ascii_classes() -> np.ndarray:
    kind = np.full(128, OTHER, np.uint8)
    for code in range(128):
        c = chr(code)
        kind[code] = (NEWLINE if c == "\n" else BLANK if c.isspace() else STOP if c in ".!?" else LETTER if c.isalpha()
                      else DIGIT if c.isdigit() else PUNCTUATION if c.isprintable() else OTHER)
    return kind


_ASCII = _ascii_classes()
#: Full stops of other scripts.
_STOPS = np.array([0x3002, 0xFF01, 0xFF0E, 0xFF1F], np.uint32)


def classes_of(code: np.ndarray) -> np.ndarray:
    """Class of each code point. Outside ASCII only full stops are told apart from letters."""
    kind = np.full(len(code), LETTER, np.uint8)
    plain = code < 128
    kind[plain] = _ASCII[code[plain]]
    kind[np.isin(code, _STOPS)] = STOP
    return kind


class Units:
    """The units of a block of texts, by ranks over character classes."""

    def __init__(self, texts: list[str], unit: str):
        kind = classes_of(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
        self.matrix, self.ends = WaveletMatrix(kind, _CLASS_BITS), UNITS[unit]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
        self.first, self.last = bounds[:-1], bounds[1:]
        self.before = self._ended(self.first)
        ended = self._ended(self.last) - self.before
        full = self.last > self.first
        closing = np.zeros(len(texts), bool)
        closing[full] = np.isin(kind[self.last[full] - 1], self.ends)
        self.count = ended + (full & ~closing)

    def _ended(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each place, from the start of the block."""
        return sum(self.matrix.rank(symbol, at) for symbol in self.ends)

    def place(self, units: np.ndarray) -> np.ndarray:
        """Code points of the first `units` units of each text."""
        low, high = self.first.copy(), self.last.copy()
        while (low < high).any():  # the smallest place before which so many units end
            middle = (low + high) >> 1
            reached = self._ended(middle) - self.before >= units
            high = np.where(reached & (low < high), middle, high)
            low = np.where(reached | (low >= high), low, middle + 1)
        return low - self.first


def numbers(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if form == "psm" else prefix + middle + suffix


def restored(form: str, output: str) -> str:
    """The text that was rewritten. Marks have no border, so the first place of each is the one that was written."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    at = [0]
    for mark in order[1:]:
        at.append(output.index(mark, at[-1] + len(order[0])))
    ends = [*at[1:], len(output)]
    part = {mark: output[a + len(mark):b] for mark, a, b in zip(order, at, ends, strict=True)}
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def rewrite(docs: DataFrame, unit: str = "line", seed: int = SEED, rewritten: int = REWRITTEN,
            suffix_first: int = SUFFIX_FIRST, digests: bool = False) -> DataFrame:
    """`row`, n (units), form, prefix_chars, middle_chars and output; with `digests` the SHA-256 of the output and of the
    restored text instead of the output."""
    h = F.array(*numbers(F.col("row.doc_id"), seed))
    rows = pack(docs).withColumn("h", h)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
              *([("output_sha256", T.StringType()), ("restored_sha256", T.StringType())] if digests
                else [("output", T.StringType())])]
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in fields)])

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in text_of(part).to_pylist()]
        h = np.array(part.column("h").to_pylist(), np.int64).reshape(-1, 4)
        units = Units(texts, unit)
        cut = np.sort(h[:, :2] % (units.count + 1)[:, None], axis=1)
        first, second = units.place(cut[:, 0]), units.place(cut[:, 1])
        forms, written, prefix_chars, middle_chars = [], [], [], []
        for text, (_, _, h3, h4), a, b in zip(texts, h.tolist(), first.tolist(), second.tolist(), strict=True):
            plain = not text or h3 % 100 >= rewritten or any(mark in text for mark in MARKS)
            form = "plain" if plain else "spm" if h4 % 100 < suffix_first else "psm"
            output = joined(form, text[:a], text[a:b], text[b:])
            forms.append(form)
            prefix_chars.append(None if plain else a)
            middle_chars.append(None if plain else b - a)
            written.append((sha256(output.encode()), sha256(restored(form, output).encode())) if digests else (output,))
        columns = [pa.array(units.count, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
                   pa.array(middle_chars, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*written, strict=True))]
        return pa.RecordBatch.from_arrays([part.column("row"), *columns], schema.names)

    def work(batches):
        for batch in batches:
            for at, n in pieces(text_of(batch), BLOCK_BYTES):
                yield block(batch.slice(at, n))

    return rows.mapInArrow(work, schema)
