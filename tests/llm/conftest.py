import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "délta", "eps.", "zeta", "Eta", "theta,", "iota", "kappa", "la", "mu", "nu", "xi", "pi", "rho"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, row int, n long, ids int, key string, size int"


def make_rows(seed: int = 1):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and columns of clashing names."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    passage = text(45)
    out = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = text(r.randrange(1, 120))
        elif kind == 1:
            t = text(30) + "\n" + passage + "\t" + text(r.randrange(5, 40))
        elif kind == 2 and out:
            t = out[-2][1]
        elif kind == 3 and out:
            ws = (out[-1][1] or "a").split(" ")
            ws[r.randrange(len(ws))] = "changed"
            t = " ".join(ws)
        elif kind == 4:
            t = r.choice([None, "", " ", "\n\t ", "one", "two words", "!!! ??"])
        else:
            t = (text(8) + "  ") * 12
        out.append((i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, ""]), len(t or "")))
    out += [(None, passage, None, None, 1), (None, None, None, None, 0), (0, out[0][1], "en", "a", 1), (1, "x " * 20_000, "en", "b", 1), (500, passage + " " + passage, "de", "c", 1)]
    return [(*o, "rid", 7, 9, 1, "k", 3) for o in out]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    from plumbline.llm.queries import tokenizer_path

    return tokenizer_path()
