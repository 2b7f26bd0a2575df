import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version string, spans string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te", "su") for b in ("ra", "ne", "do", "vi") for c in ("", "n", "s", "é")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages and lines, odd white space, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    passage, line = prose(rng, 60), "The Same  Line"
    texts += [prose(rng, 20) + " " + passage + "\t" + prose(rng, 20) for _ in range(8)]
    texts += [prose(rng, 15) + "\n  " + line.swapcase() + " \n" + prose(rng, 10) for _ in range(12)]
    base = prose(rng, 150)
    for k in range(10):
        words = base.split()
        words[k * 7] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3]] * 3 + ["x " * 300, "ab " * 7 + "\n" * 5, "", " \n\t ", None, None, "É!", "word", "a\x0bb\x0cc\rd", "日本語 テキスト " * 40, prose(rng, 6000), "same\n" * 60, "un deux " * 100]
    texts += ["#*$% & | < > " * 30, "SHOUT!! " * 40]
    rows = [(i, t, "en", "src", None, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id " + passage, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
