"""Language identification, quality rules, toxicity and the suffix tree."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conductrisk.llm import language, lm, quality, toxicity
from conductrisk.llm.rows import fold

LETTERS = {"en": "aehinorst", "de": "äbdegnuür", "fr": "aéèlmopuq"}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- language ---------------------------------------------------------------------------
def test_languages_of_held_out_rows(make):
    rng = random.Random(3)
    langs = [rng.choice(list(LETTERS)) for _ in range(300)]
    texts = [spoken(rng, x, rng.randint(5, 60)) for x in langs]
    docs = make(texts, lang=[None if i % 11 == 0 else x for i, x in enumerate(langs)])
    model = language.fit(docs, fold(4) != 2)
    assert model.languages == sorted(LETTERS)
    rows = language.identify(docs.drop("lang"), model).select("row.doc_id", "lang_pred", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_model_counts_every_gram_of_every_training_row(make):
    texts = ["abc ab", "zz", None, "", "été 日本"]
    langs = ["b", "a", "a", "b", "a"]
    model = language.fit(make(texts, lang=langs), F.lit(True))
    smooth = np.exp(model.log_probability.astype(float))
    count = Counter()
    for t, x in zip(texts, langs, strict=True):
        buckets, _ = language._grams(pa.array([t], pa.string()))
        assert len(buckets) == max(0, len(" " + (t or "") + " ") - 2)
        count.update((b, x) for b in buckets.tolist())
    for i, x in enumerate(model.languages):
        total = sum(n for (_, y), n in count.items() if y == x) + language.SMOOTHING * language.BUCKETS
        for (b, y), n in count.items():
            if x == y:
                assert smooth[b, i] == pytest.approx((n + language.SMOOTHING) / total, rel=1e-4)


def test_odd_texts_and_untrained_model(make, clashing):
    texts = [None, "", " \n ", "123 ...", "a", "é" * 50_000, "same same", "same same"]
    docs = make(texts, extra=clashing)
    rows = language.identify(docs, language.fit(docs, F.lit(True))).orderBy("row.doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und"] * 4 + ["en"] * 4 and rows[0].score == 0 and rows[0]["row"].score == "mine"
    none = language.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}
    assert language.identify(make([]), language.fit(make([]), F.lit(True))).collect() == []


def test_ties_go_to_the_first_language(make):
    docs = make(["abc", "abc"], lang=["y", "x"])
    rows = language.identify(docs, language.fit(docs, F.lit(True))).collect()
    assert {r.lang_pred for r in rows} == {"x"} and {round(r.score, 6) for r in rows} == {0.5}


# --- quality ----------------------------------------------------------------------------
def brute_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(again))


def test_counts_equal_brute_force(make, texts, clashing):
    texts = [*texts, "a#b $$ | x\na#b $$ | x\n\n \na#b $$ | x", "l\n" * 30]
    rows = quality.measured(make(texts, extra=clashing)).orderBy("row.doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == list(map(brute_counts, texts))


def test_binomial_tail_is_exact():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.05), (10, 10, 0.3)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)


def test_fixed_sequence_stops_at_the_first_failure():
    assert quality.certified(5000, [0, 0, 2, 900, 0], 0.01, 0.01) == 3
    assert quality.certified(20, [0, 0], 0.01, 0.01) == 0  # too few labels to promise anything


def test_false_rejections_keep_to_the_risk():
    """Over many draws, a cutoff whose true rate is above the risk is rarely certified."""
    rng = np.random.default_rng(5)
    bad = sum(quality.certified(800, [int(rng.binomial(800, 0.03))], 0.02, 0.05) for _ in range(2000))
    assert bad <= 2000 * 0.05


def test_rules_reject_bad_and_keep_good(make, spark):
    rng = random.Random(9)
    good = [spoken(rng, "en", 40) for _ in range(900)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in spoken(rng, "en", 40).split()) for _ in range(100)]
    docs = make(good + bad)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)] + [(5, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    cutoffs = quality.fit(docs, labels)
    assert "symbol_share" in cutoffs["en"]
    rows = quality.judge(docs, cutoffs).select("row.doc_id", "kept").collect()
    assert sum(not r.kept for r in rows if r.doc_id < 900) <= 0.02 * 900
    assert all(not r.kept for r in rows if r.doc_id >= 900)
    # no labels: the base rule alone; a null stratum is one of its own
    none = quality.judge(make([None, "", good[0]], lang=[None, "en", None]), quality.fit(docs, labels.filter("false")))
    assert [r.kept for r in none.orderBy("row.doc_id").collect()] == [False, False, True]
    assert quality.judge(make([]), cutoffs).collect() == []


def test_small_strata_get_cutoffs_too(make, spark):
    """300 good rows in each of four strata certify the rules together."""
    rng = random.Random(12)
    lang = [x for x in ("en", "de", "fr", None) for _ in range(310)]
    texts = [" ".join(w + "#" * (i % 310 >= 300) for w in spoken(rng, x or "en", 40).split()) for i, x in enumerate(lang)]
    labels = spark.createDataFrame([(i, int(i % 310 < 300)) for i in range(len(texts))], "doc_id long, quality int")
    docs = make(texts, lang=lang)
    cutoffs = quality.fit(docs, labels)
    assert all("symbol_share" in cutoffs[x] for x in ("en", "de", "fr", None))
    rows = quality.judge(docs, cutoffs).select("row.doc_id", "kept").collect()
    assert len(rows) == len(texts)
    assert all(r.kept == (r.doc_id % 310 < 300) for r in rows)


def test_a_rule_that_must_stop_does_not_hold_the_others():
    found = [{"sequence": "", "first": 3, "c": 5000}, *({"sequence": rule, "first": 0 if rule == "mean_word_length" else
             len(cuts), "c": 5000} for rule, cuts in quality.GRID.items())]
    cuts = quality._cutoffs(found, 0.02, 0.0125)
    assert cuts == {rule: None if rule == "mean_word_length" else x[-1] for rule, x in quality.GRID.items()}


# --- toxicity ---------------------------------------------------------------------------
def test_toxic_words_are_learned(make, spark, clashing):
    rng = random.Random(4)
    toxic = [i % 8 == 0 for i in range(800)]
    texts = []
    for t in toxic:
        words = spoken(rng, "en", rng.randint(10, 60)).split()
        if t:
            words.insert(rng.randrange(len(words)), rng.choice(["grumph", "blarg", "Zonk!"]))
        texts.append(" ".join(words))
    docs = make(texts, extra=clashing)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(1, 0, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, fold(5) != 0)
    assert 0 < len(model.bucket) < 2000  # L1 leaves few of a million weights
    rows = toxicity.score(docs, model).select("row.doc_id", "score", "predicted").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    odd = toxicity.score(make([None, "", "...", "x" * 50_000, "grumph", "grumph"]), model).orderBy("row.doc_id").collect()
    assert odd[0].score == odd[1].score == odd[2].score < 0.5 and odd[4].score == odd[5].score > 0.5


def _plain_features(text):
    words = re.findall("[a-z]+", text.lower())
    return {(w,) for w in words} | {(g, a, b) for g in (1, 2) for a, b in zip(words, words[g:])}


def _plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal one coordinate at a time; the intercept () has no L1 term. Gives the score of a feature set."""
    z, n = {}, {}

    def weight(f):
        strength = 0.0 if f == () else l1
        if abs(z.get(f, 0.0)) <= strength:
            return 0.0
        return (math.copysign(strength, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    def probability(have):
        return 1 / (1 + math.exp(-sum(weight(f) for f in have | {()})))

    for _ in range(epochs):
        for have, y in rows:
            g = probability(have) - y
            for f, w in [(f, weight(f)) for f in have | {()}]:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w
                n[f] = before + g * g
    return probability, {f for f in z if f and weight(f)}


def test_training_equals_a_plain_ftrl(make):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in "bdkmprst" for b in ("an", "el", "ix", "or")]
    texts, label = [], []
    for i in range(240):
        words = rng.choice(vocabulary, rng.integers(0, 14)).tolist()
        label.append(int(i % 4 == 0))
        texts.append(" ".join(words + ["Grumph", "off"] * label[-1]) + [".", "", " 7!"][i % 3])
    bucket, owner = toxicity._features(pa.array(texts))
    assert [int((owner == i).sum()) for i in range(240)] == [len(_plain_features(t)) for t in texts]
    model = toxicity.train([bucket[owner == i] for i in range(240)], label)
    plain, kept = _plain_ftrl([(_plain_features(t), y) for t, y in zip(texts, label)],
                              toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert len(model.bucket) == len(kept) > 0
    asked = texts[::7] + ["", "grumph", "off grumph ban", "unknown words only"]
    got = {r.text: r.score for r in toxicity.score(make(asked), model).select("row.text", "score").collect()}
    for t in asked:
        assert got[t] == pytest.approx(plain(_plain_features(t)), abs=1e-9)


def test_toxicity_without_labels_or_rows(make, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(make(["a b"]), labels, fold(5) != 0)
    assert [(r.score, r.predicted) for r in toxicity.score(make(["a b"]), model).collect()] == [(0.5, 1)]
    assert toxicity.score(make([]), model).collect() == []


def test_sample_is_bounded(spark):
    labels = spark.range(500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert toxicity.sample(labels, fold(5) != 0, 50).count() == 50


# --- suffix tree ------------------------------------------------------------------------
def test_symbols():
    code, bounds = lm.symbols(pa.array(["Ab  c", None, "", "\n"]))
    assert bounds.tolist() == [0, 5, 6, 7, 8]
    assert bytes((code & 255).astype(np.uint8)) == b"ab c\n\n\n\n"
    assert code[2] == (ord("a") << 16 | ord("b") << 8 | ord(" "))


def tree_of(texts):
    code, _ = lm.symbols(pa.array(texts))
    return lm.grow([np.unique(lm._low(code, d + 1), return_counts=True) for d in range(lm.DEPTH + 1)], len(code))


def test_distributions_sum_to_one_and_use_the_longest_context():
    rng = random.Random(6)
    tree = tree_of([spoken(rng, "en", 400) for _ in range(20)])
    for context in (b"\0\0\0\0\0", b"the t", b" nnnn", b"zzzzz"):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** tree.score(np.arange(256) + base)).sum() == pytest.approx(1, abs=1e-9)
    assert len(tree.contexts[0]) > 5
    for depth in range(1, lm.DEPTH):  # every suffix of a context that stays also stays
        assert np.isin(lm._low(tree.contexts[depth], depth), tree.contexts[depth - 1]).all()


def test_contexts_that_say_nothing_new_are_dropped():
    rng = np.random.default_rng(1)
    random_bytes = ["".join(rng.choice(list("abcd"), 4000)) for _ in range(5)]
    assert all(len(c) < 40 for c in tree_of(random_bytes).contexts)
    periodic = tree_of(["abcabd" * 800])  # needs contexts of three symbols
    score = periodic.score(lm.symbols(pa.array(["abcabdabcabdabcabd"]))[0])
    assert (score[9:-1] > math.log10(0.9)).all()


def test_base_score_and_counts(make, clashing):
    rng = random.Random(8)
    texts = [spoken(rng, rng.choice(list(LETTERS)), rng.randint(1, 80)) for _ in range(60)] + [None, "", "UNSEEN w0rds", "x " * 3000]
    ids = [*range(60), 60, 61, None, 63]
    rows = lm.score(make(texts, ids, extra=clashing), lambda c: fold(5, c) != 1).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    name = lambda i: b"" if i is None else str(i).encode()
    c = Counter(w for i, t in zip(ids, texts, strict=True) if zlib.crc32(name(i)) % 5 != 1 for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    got = {r["row"].doc_id: r for r in rows}
    assert len(got) == 64
    for i, t in zip(ids, texts, strict=True):
        r, w = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(name(i)) % 5 == 1, len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
        assert r.score < 0 and r["row"].score == "mine"


def test_nothing_to_learn_from(make):
    rows = lm.score(make(["a b", None]), lambda c: F.lit(False)).orderBy("row.doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    assert rows[0].score == pytest.approx(4 * math.log10(1 / 256))
    assert lm.score(make([]), lambda c: F.lit(True)).collect() == []


def test_contexts_of_a_large_corpus_need_no_share_of_it():
    code, _ = lm.symbols(pa.array(["abcabd" * 800]))
    counts = [np.unique(lm._low(code, d + 1), return_counts=True) for d in range(lm.DEPTH + 1)]
    assert [len(x) > 0 for x in lm.grow(counts, 10**11).contexts[:3]] == [True] * 3


def test_buckets_and_blocks_give_the_scores_of_one_tree(make, monkeypatch):
    for name, value in (("BUCKET_GRAMS", 300), ("BLOCK_BYTES", 3000), ("BLOCKS_A_TASK", 2)):
        monkeypatch.setattr(lm, name, value, raising=False)
    rng = random.Random(9)
    texts = [spoken(rng, rng.choice(list(LETTERS)), rng.randint(1, 200)) for _ in range(80)] + [
        None, "", "a b a b", *["abcdef1 xbcdef2 " * 30] * 3]
    tree = tree_of([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1])
    code, bounds = lm.symbols(pa.array(texts))
    assert all(len(x) for x in tree.contexts)
    got = {r["row"].doc_id: r.score for r in lm.score(make(texts), lambda c: fold(5, c) != 1).collect()}
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        assert got[i] == pytest.approx(tree.score(code[a:b]).sum(), abs=1e-9)


def test_the_sixth_symbol_before_counts():
    # after "bcdef" comes what its first letter says
    texts = ["abcdef1 xbcdef2"] * 400
    code, bounds = lm.symbols(pa.array(["abcdef1", "xbcdef2"]))
    score = tree_of(texts).score(code)
    assert score[bounds[1:] - 2].min() > math.log10(0.9)


def test_counts_travel_as_lists_and_are_whole(make, monkeypatch):
    """No row per n-gram and task is shuffled; the sums of all lists are the counts."""
    for name, value in (("COUNT_BYTES", 2000), ("COUNT_SYMBOLS", 5000), ("_FLUSH", 100)):
        monkeypatch.setattr(lm, name, value, raising=False)
    rng = random.Random(14)
    texts = [spoken(rng, rng.choice(list(LETTERS)), rng.randint(1, 300)) for _ in range(60)] + [None, "", "A b\x0bc", *["xyz " * 400] * 5]
    found = lm.counted(make(texts).repartition(3), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan
    rows = found.collect()
    want = [Counter(), Counter()]
    for t in texts:
        data = b"\0" * lm.DEPTH + b" ".join((t or "").encode().lower().split()) + b"\n"
        want[0].update(int.from_bytes(data[i - lm.DEPTH:i + 1], "big") for i in range(lm.DEPTH, len(data)))
        words, _ = lm._words(pa.array([t], pa.string()))
        want[1].update([*words.view(np.int64).tolist(), int(lm.END_WORD.view(np.int64))])
    assert len(rows) == len(want[0]) + len(want[1])
    assert [{r.value: r.c for r in rows if r.kind == k} for k in (0, 1)] == want


def test_requests_are_lists_and_texts_are_shuffled_once(make, monkeypatch):
    """Words are asked for as codes are: no row per word and block, no join, and one pass over a block finds both."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    rng = random.Random(15)
    docs = make([spoken(rng, rng.choice(list(LETTERS)), 60) for _ in range(60)] + [None, "\n"])
    plan = lm.score(docs, lambda c: fold(5, c) != 1)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    table = docs.selectExpr("struct(*) row", "7L block").toArrow()
    found = lm._asked((5, 3), 2)(table)
    texts = [x["text"] for x in table.column("row").to_pylist()]
    for kind, want in enumerate((lm.symbols(pa.array(texts))[0], lm._words(pa.array(texts))[0].view(np.int64))):
        lists = [x for x in found.to_pylist() if x["kind"] == kind]
        assert len(lists) <= (5, 3)[kind] and {(x["block"], x["salt"]) for x in lists} == {(7, 1)}
        got = np.concatenate([np.cumsum(lm._restored(x["asked"], x["n"], np.int64)) for x in lists])
        assert sorted(got.tolist()) == np.unique(want).tolist()


def test_a_bucket_restores_some_lists_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "_FLUSH", 100)
    monkeypatch.setattr(lm, "_find", lambda ordered, wanted, find=lm._find: (sizes.append(len(wanted)), find(ordered, wanted))[1])
    sizes, rng = [], np.random.default_rng(16)
    lists = [np.unique(rng.integers(-500, 500, 60)) for _ in range(30)] + [np.arange(250)]
    left = pa.table({"kind": pa.array([1] * 31, pa.int32()), "block": list(range(31)), "n": [len(x) for x in lists],
                     "asked": pa.array([lm._squeezed(np.diff(x, prepend=0)) for x in lists], pa.binary())})
    words = rng.permutation(np.arange(-400, 400, 2))
    found = lm._answers(None)(left, pa.table({"value": words, "c": np.abs(words) + 1}))
    for x, row in zip(lists, found.to_pylist(), strict=True):
        got = lm._restored(row["found"], row["n"], np.int64)
        assert got.tolist() == [abs(v) + 1 if v % 2 == 0 and -400 <= v < 400 else 0 for v in x.tolist()]
    assert sorted(sizes)[-2] <= 100 and max(sizes) == 250  # a longer list is restored by itself


@pytest.mark.parametrize("n", [0, 1, 2, 100, 101, 102, 5000])
def test_runs_are_counted_in_place(monkeypatch, n):
    monkeypatch.setattr(lm, "_FLUSH", 100)
    values = np.random.default_rng(n).integers(-n, n + 1, n)
    for x in (values, np.arange(n), np.zeros(n, np.int64)):
        want = np.unique(x, return_counts=True)
        assert [y.tolist() for y in lm._runs(x.copy())] == [y.tolist() for y in want]


def test_counted_symbols_go_before_their_lists_are_made(monkeypatch):
    """While n-grams are dealt to lists, the symbols they were counted from take no memory."""

    class Docs:
        select = groupBy = lambda self, *columns: self
        applyInArrow = lambda self, work, schema: None

        def mapInArrow(self, work, schema):
            self.work = work
            return self

    docs, held = Docs(), []
    monkeypatch.setattr(lm, "pack", lambda x: x)
    monkeypatch.setattr(lm, "_dealt", lambda *x, dealt=lm._dealt: (held.append(tracemalloc.get_traced_memory()[0]), dealt(*x))[1])
    lm.counted(docs, 3)
    batch = pa.record_batch({"row": pa.array([{"text": "abc abd " * 1000}] * 400)})
    tracemalloc.start()
    try:
        found = list(docs.work(iter([batch])))
    finally:
        tracemalloc.stop()
    assert [x.column("kind")[0].as_py() for x in found] == [0, 1]
    assert held[0] < 8 * lm.COUNT_SYMBOLS
