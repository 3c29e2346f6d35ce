import random

import pytest

from wardline.llm.common import ready

#: Names that operators use inside; a table may have them too.
EXTRA = "set_id component key row doc n z part size rank score chunk block leader text_id"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else
            "".join(rng.choice(["an", "er", "th", "É", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(5)
    base, passage = words(rng, 220), " ".join(words(rng, 60))
    out = [" ".join(base), " ".join(base).upper().lower(), " ".join(base)]
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz%d" % rng.randrange(1000)
        out.append(" ".join(w))
    out += [" ".join(words(rng, 40)) + " " + passage + "\n" + " ".join(words(rng, 30)) for _ in range(10)]
    out += ["", None, "One", "one", "a b c d", "A  b\tc\nd", "a b c d e", " \n", "ab " * 300, "ab " * 301, "x" * 5000]
    out += [" ".join(words(rng, 6000)), "<|endoftext|> é日本🙂 \u2581\u2581 x", "!!! " * 50, "THE!! " * 80]
    out += [" ".join(words(rng, rng.randint(1, 150))) for _ in range(30)]
    rows = list(enumerate(out))
    return rows + [rows[0], rows[5]] + [(None, "no id " + passage), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    ready(spark)
    extra = EXTRA.split()
    rows = [(i, t, "en", "src", None if t is None else len(t), *[7] * len(extra)) for i, t in texts]
    kinds = ", ".join(f"{c} int" for c in extra)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")
