"""Closed-syncmer fingerprints."""

import hashlib

import pytest
from pyspark.sql import functions as F

from conductrisk.llm import syncmers


def anchored(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows = syncmers.with_anchors(df, F.col("t"), "a", "i").orderBy("i").collect()
    return [r.a for r in rows]


def word_hashes(spark, words):
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    return {r.w: r.h for r in df.select("w", F.xxhash64("w").alias("h")).collect()}


def test_anchors_are_the_closed_syncmers(spark):
    import random
    rng = random.Random(3)
    words = [f"w{rng.randrange(30)}" for _ in range(60)]
    text = " \t".join(words) + "\n"
    hashes, k = word_hashes(spark, words), syncmers.KMER
    places = {}
    for i in range(len(words) - k + 1):
        inner = [hashes[w] for w in words[i:i + k]]
        if min(inner) in (inner[0], inner[-1]):
            places.setdefault(tuple(inner), i)
    mask = (1 << syncmers.PLACE_BITS) - 1
    found = anchored(spark, [text])[0]
    assert {x & mask for x in found} == set(places.values())
    assert found == sorted(found) and len({x >> syncmers.PLACE_BITS for x in found}) == len(found)


def test_context_free(spark):
    """A k-mer is an anchor or not, whatever stands around it."""
    middle = "a quick brown fox jumps over some lazy dogs and runs far away"
    a, b = anchored(spark, ["one two three four five " + middle, middle + " six seven eight nine ten"])
    hash_of = lambda found: {x >> syncmers.PLACE_BITS for x in found}
    inner = hash_of(anchored(spark, [middle])[0])
    assert inner <= hash_of(a) and inner <= hash_of(b)


def likeness(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string")
    rows = syncmers.with_anchors(syncmers.with_anchors(df, F.col("x"), "a", "i", "y"), F.col("y"), "b", "i", "a")
    return {r.i: r for r in syncmers.with_likeness(rows, "a", "b", "n").collect()}


def test_short_texts_are_only_like_themselves(spark):
    """Every text with a word has an anchor, so different short texts share none by being empty."""
    import random
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(1, 10) for _ in range(40)]
    got = likeness(spark, list(zip(texts, texts[1:] + texts[:1], strict=True)))
    assert all(r.a and r.b and r.n == 0 for r in got.values())
    assert all(r.n == 1 for r in likeness(spark, list(zip(texts, texts, strict=True))).values())


def test_no_anchor_of_a_long_text_is_lost(spark):
    import random
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**5)}" for _ in range(20_000)]
    edited = words[:15_000] + [f"x{rng.randrange(10**5)}" for _ in range(5_000)]
    hashes, k = word_hashes(spark, words + edited), syncmers.KMER

    def kmers(x):
        found = {}
        for i in range(len(x) - k + 1):
            inner = [hashes[w] for w in x[i:i + k]]
            if min(inner) in (inner[0], inner[-1]):
                found.setdefault(tuple(inner), i)
        return found

    left, right = kmers(words), kmers(edited)
    row = likeness(spark, [(" ".join(words), " ".join(edited))])[0]
    assert len(row.a) == len(left) > 6_000 and len(row.b) == len(right)
    assert row.n == pytest.approx(len(left.keys() & right.keys()) / len(left.keys() | right.keys()), abs=1e-3)


def test_writing_without_blanks(spark):
    import random
    rng = random.Random(7)
    chinese = "".join(chr(0x4E00 + rng.randrange(5_000)) for _ in range(400))
    other = "".join(chr(0x4E00 + rng.randrange(5_000)) for _ in range(400))
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    got = likeness(spark, [(chinese, chinese[:300] + other[:100]), (chinese, other), (letters, letters[:300] + letters[:100][::-1]),
                           (letters, letters[::-1]), ("x" * 41, "x" * 39)])
    assert 0.5 < got[0].n < 0.7 and got[1].n < 0.05 and 0.5 < got[2].n < 0.7 and got[3].n < 0.05 and len(got[4].b) == 1


def brute(rows):
    """Edited text of each (id, text); ids are distinct."""
    order = sorted(rows)
    out = {}
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1] or ""
        text = text or ""
        quarter = len(text) // 4
        out[i] = (len(text), text[:len(text) - quarter] + following[:quarter])
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_edited_texts(make, texts, partitions):
    ids = [7 * i - 20 for i in range(len(texts))]
    rows = syncmers.fingerprints(make(texts, ids), partitions).collect()
    want = brute(list(zip(ids, texts, strict=True)))
    assert {r.doc_id: (r.n_chars, r.edited) for r in rows} == want and len(rows) == len(texts)
    by_text = {}
    for r, t in ((r, texts[(r.doc_id + 20) // 7] or "") for r in rows):
        assert by_text.setdefault(t, r.anchors) == r.anchors
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows if r.n_chars > 400 and len(r.anchors) > 20]
    assert all(r.near_edited > 0.35 for r in long)


def test_likeness(spark):
    base = " ".join(f"w{i}" for i in range(200))
    shifted = "new words in front " + base
    mixed = " ".join(f"w{i}" for i in reversed(range(200)))
    df = spark.createDataFrame([(0, base, base), (1, base, shifted), (2, base, mixed), (3, "", ""), (4, "", "x"), (5, "a b", "a b")],
                               "i long, x string, y string")
    rows = syncmers.with_anchors(syncmers.with_anchors(df, F.col("x"), "a", "i", "y"), F.col("y"), "b", "i", "a")
    got = {r.i: r.n for r in syncmers.with_likeness(rows, "a", "b", "n").collect()}
    assert got[0] == 1 and got[1] > 0.9 and got[2] < 0.2 and got[3] == 1 and got[4] == 0 and got[5] == 1


def test_odd_rows(make, clashing):
    text = "some words that stand here for a while"
    docs = make([text, text, text, None, ""], [4, 4, None, 2, 9], extra=clashing)
    rows = syncmers.fingerprints(docs).collect()
    assert len(rows) == 5
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[4]) == 2 and by_id[4][0] == by_id[4][1]
    assert by_id[None][0].edited == text[:len(text) - len(text) // 4] and by_id[None][0].near_next == 0
    assert by_id[2][0].n_chars == 0 and by_id[2][0].edited == "" and by_id[9][0].near_next == 1
    assert syncmers.fingerprints(make([])).collect() == []
    one = syncmers.fingerprints(make(["a b c d e f g h"])).collect()[0]
    assert one.near_next == 1 and one.edited == "a b c d e f a b"[:len("a b c d e f g h") - 3] + "a b"


def test_registered_query_equals_brute_force(spark):
    import duckdb
    from conductrisk.llm.fingerprint_queries import op5_syncmer_fingerprints as query
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in query(spark, sf).collect()}
    want = brute(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert {i: (r.n_chars, r.edited_sha256) for i, r in rows.items()} == {
        i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, (n, e) in want.items()}


def test_no_python_in_the_plan(make, texts):
    plan = syncmers.fingerprints(make(texts))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD"))
