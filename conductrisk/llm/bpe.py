"""Byte-level BPE with DuckDB: recursive contraction of token rows, ordered aggregation to decode.

Every task splits its texts by the tokenizer's pattern and sends the distinct pieces it has not
met yet to an in-process DuckDB. There each piece is a set of rows (piece, position, token). A
recursive query joins neighbouring rows with the merge table and contracts the leftmost pair of
the smallest rank of every piece, until no pair is left. Token ids are aggregated in order of position; the
decoder joins ids with the vocabulary and aggregates their bytes in order.

Only the vocabulary file is read on the executors (its path is a parameter; the file comes with an
installed package). Null and empty texts have no token. Repeated rows are encoded alike. Memory per
task is bounded by `BATCH_ROWS` and `CACHE_PIECES`, whatever the size of the input; a text longer than a
slice is a slice of its own.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from conductrisk.llm.rows import map_texts, sha256, text_of

#: Most token rows in one recursive query, and most encoded pieces kept for later slices of a task.
BATCH_ROWS, CACHE_PIECES = 400_000, 1_600_000
#: Pieces with more characters are contracted at all places of a rank at once.
LONG_PIECE = 48

# A round has the tokens of every unfinished piece. `best` holds the smallest rank among the pairs of a
# piece and the leftmost place where it occurs, as rank * 2^32 + place; the two tokens there become
# one in the next round. A piece without a pair has no best: these rows are the result.
_RANKED = """
    SELECT s.piece, s.pos, s.token, m.rank
    FROM (SELECT piece, pos, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS following FROM {rows}) s
    LEFT JOIN merges m ON m.pair = s.token::BIGINT * 4294967296 + s.following
"""
_BEST = "SELECT piece, min(rank * 4294967296 + pos) AS best FROM ranked WHERE rank IS NOT NULL GROUP BY piece"
_ROUND = "SELECT r.piece, r.pos, r.token, b.best FROM ranked r LEFT JOIN best b ON r.piece = b.piece"
_CONTRACTED = """
    SELECT piece, pos, CASE WHEN pos = best % 4294967296 THEN (best // 4294967296)::INTEGER ELSE token END AS token
    FROM (SELECT *, lag(pos) OVER (PARTITION BY piece ORDER BY pos) AS before FROM rounds WHERE best IS NOT NULL)
    WHERE before IS NULL OR before <> best % 4294967296
"""
_ENCODE = f"""
WITH RECURSIVE rounds(piece, pos, token, best) AS (
    (WITH ranked AS MATERIALIZED ({_RANKED.format(rows="symbols")}), best AS ({_BEST}) {_ROUND})
  UNION ALL
    (WITH kept AS MATERIALIZED ({_CONTRACTED}),
          ranked AS MATERIALIZED ({_RANKED.format(rows="kept")}), best AS ({_BEST}) {_ROUND})
)
SELECT piece, list(token ORDER BY pos) AS ids FROM rounds WHERE best IS NULL GROUP BY piece
"""
# The same for long pieces: a round contracts all occurrences of the smallest rank, not only the leftmost, where no
# merge with the new token has a smaller rank still (`calm`), so that the order of these contractions can't matter. In
# a run of overlapping occurrences every second one counts from the left.
_LONG_RANKED = _RANKED.replace("m.rank", "m.rank, m.calm")
_LONG_ROUND = ("SELECT r.piece, r.pos, r.token, b.best, r.rank = b.best // 4294967296 AND (r.calm OR r.pos = b.best % 4294967296)"
               " AS hit FROM ranked r LEFT JOIN best b ON r.piece = b.piece")
_LONG_CONTRACTED = """
    SELECT piece, pos, CASE WHEN taken THEN (best // 4294967296)::INTEGER ELSE token END AS token
    FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY piece ORDER BY pos) AS gone
          FROM (SELECT *, coalesce(hit AND ((pos - max(CASE WHEN hit AND NOT before THEN pos END)
                          OVER (PARTITION BY piece ORDER BY pos)) // step) % 2 = 0, false) AS taken
                FROM (SELECT piece, pos, token, best, coalesce(hit, false) AS hit,
                             lag(coalesce(hit, false), 1, false) OVER (PARTITION BY piece ORDER BY pos) AS before,
                             lead(pos) OVER (PARTITION BY piece ORDER BY pos) - pos AS step
                      FROM rounds WHERE best IS NOT NULL)))
    WHERE NOT gone
"""
_ENCODE_LONG = f"""
WITH RECURSIVE rounds(piece, pos, token, best, hit) AS (
    (WITH ranked AS MATERIALIZED ({_LONG_RANKED.format(rows="symbols")}), best AS ({_BEST}) {_LONG_ROUND})
  UNION ALL
    (WITH kept AS MATERIALIZED ({_LONG_CONTRACTED}),
          ranked AS MATERIALIZED ({_LONG_RANKED.format(rows="kept")}), best AS ({_BEST}) {_LONG_ROUND})
)
SELECT piece, list(token ORDER BY pos) AS ids FROM rounds WHERE best IS NULL GROUP BY piece
"""
_DECODE = """
SELECT piece, string_agg(hex, '' ORDER BY pos) AS bytes
FROM (SELECT piece, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded)
JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token's bytes and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one Python process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[token[:i]] << 32 | ranks[token[i:]], rank) for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.execute("SET preserve_insertion_order = false")
        self._fill("pairs", pair=pa.array([p for p, _ in pairs], pa.int64()),
                   rank=pa.array([r for _, r in pairs], pa.int64()))
        # calm: no merge that takes the new token as a part has a smaller rank than the token
        self.con.execute("""
            CREATE TABLE merges AS SELECT p.*, coalesce(least > p.rank, true) AS calm FROM pairs p LEFT JOIN (
                SELECT part, min(rank) AS least FROM (
                    SELECT pair >> 32 AS part, rank FROM pairs UNION ALL SELECT pair & 4294967295, rank FROM pairs)
                GROUP BY part) l ON l.part = p.rank""")
        self._fill("vocabulary", id=pa.array(list(ranks.values()), pa.int32()),
                   hex=pa.array([token.hex() for token in ranks]))
        # ids of each piece; and its decoded bytes, where they are not the piece itself
        self.known: dict[str, bytes] = {}
        self.changed: dict[str, bytes] = {}

    def _fill(self, name: str, **columns: pa.Array) -> None:
        rows = pa.table(columns)  # noqa: F841  DuckDB finds it by its name
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _run(self, batch: list[bytes], query: str) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each piece."""
        sizes = np.array([len(x) for x in batch], np.int64)
        start = np.cumsum(sizes) - sizes
        symbols = self.single[np.frombuffer(b"".join(batch), np.uint8)]
        self._fill("symbols", piece=pa.array(np.repeat(np.arange(len(batch), dtype=np.int32), sizes)),
                   pos=pa.array((np.arange(sizes.sum()) - np.repeat(start, sizes)).astype(np.int32)),
                   token=pa.array(symbols))
        self.con.execute(f"CREATE OR REPLACE TABLE encoded AS {query}")
        ids = self.con.sql("SELECT ids FROM encoded ORDER BY piece").to_arrow_table().column("ids").combine_chunks()
        text = self.con.sql(_DECODE).to_arrow_table().column("bytes").to_pylist()
        flat, bounds = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [(flat[a:b].tobytes(), bytes.fromhex(x)) for a, b, x in zip(bounds[:-1], bounds[1:], text, strict=True)]

    def learn(self, wanted: set[str]) -> None:
        """Encode the pieces that are not known yet, in queries of bounded size."""
        new = [x for x in wanted if x not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known, self.changed, new = {}, {}, list(wanted)
        new.sort(key=len)
        while new:
            # longer pieces need more rounds, so they stay among themselves
            query = _ENCODE if len(new[0]) <= LONG_PIECE else _ENCODE_LONG
            rows = n = 0
            while n < len(new) and (n == 0 or rows + len(new[n]) <= BATCH_ROWS and (len(new[n]) <= LONG_PIECE) == (query is _ENCODE)):
                rows += len(new[n])
                n += 1
            batch, new = new[:n], new[n:]
            for x, (ids, text) in zip(batch, self._run([x.encode() for x in batch], query), strict=True):
                self.known[x] = ids
                if text != x.encode():
                    self.changed[x] = text

    def decoded(self, parts: list[str]) -> bytes:
        """The bytes that the ids of these pieces stand for."""
        if not self.changed:
            return "".join(parts).encode()
        return b"".join([self.changed.get(x) or x.encode() for x in parts])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """`row`, n_tokens, ids (array of int, if asked for), ids_sha256, decoded (binary, if asked for), decoded_sha256."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())]

    def work(batch):
        coder = codec(path, pattern)
        split = [coder.pieces(x or "") for x in text_of(batch).to_pylist()]
        coder.learn(set().union(*split))
        known = coder.known
        ids = [b"".join([known[x] for x in parts]) for parts in split]
        texts = [coder.decoded(parts) for parts in split]
        out = [[len(x) // 4 for x in ids], [sha256(x) for x in ids], [sha256(x) for x in texts]]
        if with_ids:
            out += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array(texts, pa.binary())]
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), *out[3:]]

    return map_texts(docs, work, fields)
