import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, kept string, n_words string, _chunk int, digest string"


def make_docs():
    """Texts with copies, near copies, shared passages, nulls, blanks, odd characters, one long text; ids with a gap and a negative one."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    texts = [" ".join(words(r.randint(1, 120))) for _ in range(40)]
    texts += texts[:6] + [texts[0]] * 5
    base = words(150)
    for k in range(4):
        near = list(base)
        near[10 * k + 3] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(words(20) + passage + words(15)) for _ in range(4)]
    texts += [None, "", None, "   \n\t ", "12 34 !!", "é à ü Ünïcode ÀB", "Case CASE case", "x", " ".join(words(6000)), "a b c d", "</s> <|endoftext|> [INST]", "日本語 テスト 😀"]
    ids = [-3, *range(1, len(texts) + 1)]
    ids.remove(7)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    rows = [(i, t, ["en", "fr", None][i % 3], None, None, "x", "y", None, "z", 1, "d") for i, t in docs_rows]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated ids with other texts, repeated rows."""
    rows = [(None, "one two three four five"), (None, None), (5, "one two three four five"), (5, "other words stand in here"), (5, "one two three four five"), (9, "other words stand in here"), (2, "")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "k", "z", 1, "d") for i, t in rows], COLUMNS)
