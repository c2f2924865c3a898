import random

import pytest

DOCS = ("doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
        "shard INT, slot LONG, th LONG, fp STRING, id STRING, row INT, score DOUBLE")


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    """A document table from (doc_id, text[, source]); it carries clashing extra columns."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text, source = (*r, "s0")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text), 7, 7, 7, "x", "y", 7, 0.5))
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, odd white space and edge cases."""
    rng = random.Random(3)
    words = vocabulary(60)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(say(9) for _ in range(7))
    texts = [say(rng.randint(1, 120)) for _ in range(25)]
    texts += [texts[0], texts[0], texts[1]]
    near = say(150).split(" ")
    for i in range(12):
        one = list(near)
        one[10 * i] = "zz%d" % i
        texts.append(" ".join(one))
    texts += [say(20) + "\n" + passage + "\n" + say(rng.randint(1, 30)) for _ in range(8)]
    texts += ["\n".join(say(5) for _ in range(12)) for _ in range(6)]
    texts += [None, None, "", "", " ", "\n\n\n", "one", "A", "a a a a a a a a a a a a a a", "x" * 700, "xy" * 500,
              say(4000), "Ünï  çødé x \t y ", "double  blanks   here ", "<|endoftext|> ends"]
    return texts
