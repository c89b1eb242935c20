"""Document fingerprints from closed syncmers, with DataFrame functions only.

Tokens are the text's words; a k-mer is `KMER` consecutive tokens. It is an anchor if the smallest hash
among its inner tokens is that of its first or last one (a closed syncmer with inner substrings of
one token). Whether a k-mer is an anchor depends on its own tokens alone, so an edit moves only
the anchors that touch it. A text with fewer tokens than a k-mer is one anchor; a text whose few
k-mers hold no syncmer has its smallest k-mer as its only anchor. So every text with a word has an anchor.

Writing without blanks would be one long word, so each ideograph, syllable or kana letter is a token of its own, and
so is each character of a word that has `LONG_WORD` more characters on one side of it.

The fingerprint is all distinct anchors, in order of their hashes, each with the number of the
token where it first starts. Likeness compares two fingerprints: the share of common anchors among the anchors of
both, where a common anchor only counts if its shift in position is close to the usual shift of all of them.

A null text is empty; an empty text has no anchor and is like nothing, but two empty texts are
alike (1). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conductrisk.session import stage

KMER = 5
#: Characters of a word beyond which its characters are tokens.
LONG_WORD = 40
#: Bits of an anchor that hold the position; longer texts count further tokens at the last one.
PLACE_BITS = 22
#: Tokens by which a pair's shift may differ from the usual one.
SLACK = 8

_BLANKS, _BLANK_CHARACTERS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
_WORD_CHARACTER = r"[^\x20\x09-\x0D]"
#: Scripts that are written without blanks: ideographs, kana, Hangul and their wide forms.
_SINGLE = r"[\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}]"


def _spaced(text: Column) -> Column:
    """The text with blanks around characters that are tokens of their own."""
    single = F.when(text.rlike(_SINGLE), F.regexp_replace(text, f"({_SINGLE})", " $1 ")).otherwise(text)
    long = f"{_WORD_CHARACTER}{{{LONG_WORD}}}"
    return F.when(single.rlike(long), F.regexp_replace(single, f"(?<={long})|(?={long})", " ")).otherwise(single)


def with_anchors(df: DataFrame, text: Column, name: str, *keep: str) -> DataFrame:
    """`keep` and the column `name`: an array of hash << PLACE_BITS | position, in ascending order.

    Each step is a projection of its own, so that no array is computed twice.
    """
    trimmed = df.select(*keep, F.btrim(_spaced(F.coalesce(text, F.lit(""))), F.lit(_BLANK_CHARACTERS)).alias("_t"))
    words = trimmed.select(*keep, F.when(F.col("_t") == "", F.array().cast("array<string>"))
                           .otherwise(F.split("_t", _BLANKS)).alias("_w"))
    hashed = words.select(*keep, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    inner = ", ".join(f"_h[i + {j}]" for j in range(KMER))
    place = f"least(i, {(1 << PLACE_BITS) - 1})"
    pack = lambda value: f"shiftleft(shiftrightunsigned({value}, {PLACE_BITS + 1}), {PLACE_BITS}) | {place}"
    every = lambda value: f"transform(sequence(0, size(_h) - {KMER}), i -> {value})"
    packed = pack(f"xxhash64({inner})")
    syncmer = f"if(least({inner}) in (_h[i], _h[i + {KMER - 1}]), {packed}, null)"
    short = f"array({pack('xxhash64(concat_ws(chr(32), transform(_h, h -> string(h))))').replace(place, '0')})"
    found = hashed.select(*keep, "_h", F.expr(f"""
        case when size(_h) = 0 then array() when size(_h) < {KMER} then {short}
        else filter({every(syncmer)}, x -> x is not null) end""").alias("_f"))
    whole = found.select(*keep, F.expr(f"""
        case when size(_f) = 0 and size(_h) > 0 then array(array_min({every(packed)})) else sort_array(_f) end""").alias("_a"))
    # of equal hashes the first position stays
    return whole.select(*keep, F.expr(f"""filter(_a, (x, i) -> i = 0
        or shiftright(x, {PLACE_BITS}) <> shiftright(_a[i - 1], {PLACE_BITS}))""").alias(name))


def as_text(anchors: str) -> Column:
    """Hexadecimal anchors, joined by blanks."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.hex(x))), " ")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the likeness (0 to 1) of two fingerprints.

    The anchors of both are sorted together, the lowest bit telling the side; a common one stands beside its like then.
    """
    place = (1 << PLACE_BITS) - 1
    both = df.withColumn("_m", F.expr(f"""sort_array(concat(
        transform({a}, x -> shiftleft(x, 1)), transform({b}, x -> shiftleft(x, 1) | 1)))"""))
    of = lambda x: f"(shiftrightunsigned({x}, 1) & {place})"
    shifted = both.withColumn("_s", F.expr(f"""sort_array(filter(transform(_m, (x, i) ->
        if(i > 0 and shiftrightunsigned(x, {PLACE_BITS + 1}) = shiftrightunsigned(_m[greatest(i - 1, 0)], {PLACE_BITS + 1}),
           ({of('x')} - {of('_m[greatest(i - 1, 0)]')}) * (1 - 2 * (x & 1)), null)), x -> x is not null))"""))
    near = F.expr(f"size(filter(_s, x -> abs(x - _s[int(size(_s) / 2)]) <= {SLACK}))")
    likeness = F.when(F.size("_m") == 0, F.lit(1.0)).when(F.size("_s") == 0, F.lit(0.0)).otherwise(
        near / (F.size("_m") - F.size("_s")))
    return shifted.withColumn(name, likeness).drop("_m", "_s")


def ring(docs: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, next_id, n_chars): every id and the next one in ascending order; after the last comes the first.

    Ids are dealt in ranges and each range is ordered by itself; what joins the ranges is one row per range. Several rows
    of one id count once here, and a null id is left out.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    dealt = stage(ids.repartitionByRange(partitions, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = dealt.withColumn("after", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    # one row per range: at most `partitions` rows
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    edges = firsts.select("part", F.coalesce(
        F.lead("first").over(order), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("edge"))
    return inside.join(F.broadcast(edges), "part").select("doc_id", F.coalesce("after", "edge").alias("next_id"), "n_chars")


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) with its own fingerprint, that of its edited text, and three likenesses.

    The edited text has its last quarter (floor(n_chars / 4) characters) replaced by as many first characters of
    the next document. Of several rows with one id, the one with the smallest head stands for the id as
    next document. A row without id has no next document: its edited text just ends earlier, near_next is 0.
    Columns: doc_id, n_chars, edited, anchors, edited_anchors, next_anchors, near_edited, near_next.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    placed = docs.filter("doc_id is not null")
    links = ring(docs, partitions)
    to_next = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"),
                           F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("int").alias("quarter"))
    # the text is shuffled by id once: both joins read that exchange
    heads = with_anchors(
        placed.join(to_next, "doc_id").withColumn("head", F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.col("quarter"))),
        F.col("text"), "next_anchors", "before", "head")
    heads = heads.groupBy(F.col("before").alias("doc_id")).agg(F.min(F.struct("head", "next_anchors")).alias("next"))
    alone = docs.filter("doc_id is null").withColumn("next", F.lit(None).cast(heads.schema["next"].dataType))
    paired = placed.join(heads, "doc_id").unionByName(alone)
    whole = F.coalesce("text", F.lit(""))
    quarter = F.floor(F.length(whole) / 4).cast("int")
    edited = F.concat(F.substring(whole, F.lit(1), F.length(whole) - quarter),
                      F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), quarter))
    rows = paired.select("doc_id", whole.alias("text"), F.length(whole).cast("long").alias("n_chars"), edited.alias("edited"),
                         F.coalesce("next.next_anchors", F.array().cast("array<bigint>")).alias("next_anchors"),
                         F.col("next").isNull().alias("_alone"))
    keep = ["doc_id", "n_chars", "edited", "next_anchors", "_alone"]
    rows = with_anchors(rows, F.col("text"), "anchors", *keep)
    rows = with_anchors(rows, F.col("edited"), "edited_anchors", *keep, "anchors")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited")
    rows = with_likeness(rows, "anchors", "next_anchors", "near_next")
    return rows.withColumn("near_next", F.when(F.col("_alone"), 0.0).otherwise(F.col("near_next"))).drop("_alone")
