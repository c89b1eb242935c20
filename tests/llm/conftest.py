import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def random_text(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, periodic runs, and the odd cases."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    plain = [random_text(rng, rng.randint(1, 160), words) for _ in range(40)]
    passage = random_text(rng, 45, words)
    shared = [random_text(rng, 15, words) + passage + random_text(rng, rng.randint(0, 30), words) for _ in range(8)]
    near = []
    for i in range(6):
        w = plain[3].split()
        w[(7 * i) % len(w)] = f"edit{i}"
        near.append(" ".join(w))
    odd = [None, "", "   \n\t ", "x", "one two three", "ha " * 90, "ab" * 300, "word " + "y" * 4000,
           "Ünï cödé 日本語 🙂 " * 12, passage * 3, "A B C D E f g", "a b c d e F G"]
    return plain + shared + near + [plain[0], plain[0], plain[5]] + odd


@pytest.fixture
def make(spark):
    def build(texts, ids=None, lang=None, extra=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang[k] if lang else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""))
                for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        return df.selectExpr("*", *extra) if extra else df

    return build


@pytest.fixture
def clashing():
    """Columns that are named as the operators name theirs."""
    names = ["row", "k", "d", "h", "runs", "hits", "n_words", "n_removed", "kept", "score", "component_id", "n",
             "label", "block", "shard", "bin", "part", "anchors", "edited", "next", "lang_pred", "ids"]
    return [f"'mine' as {x}" for x in names]
