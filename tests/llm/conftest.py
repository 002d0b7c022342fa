import random

import pytest

WORDS = "the of and to in is that it for on was with as by at from these which one had not are but were all".split()


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    plain = lambda n: " ".join(rng.choice(WORDS) if rng.random() < 0.5 else word() for _ in range(n))
    passage = plain(60)
    out = [plain(rng.randint(1, 150)) for _ in range(30)]
    out += [out[0], out[0], out[1] + " tail", None, "", " \n\t ", "one", "a b c", "x" * 5000, "ab " * 900,
            plain(10) + " " + passage + " " + plain(9), passage, plain(5) + "\n" + passage, "Mixed CASE %%% 12 | 中文 é",
            plain(4000), "For For For For " * 40]
    return list(enumerate(out, start=3))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Extra columns have names that the operators use inside, and an array-typed one."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "B"][i % 4], 0, "x", ["y"]) for i, t in texts]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row int, word string, kind array<string>").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A null id, a repeated row, and one id with two texts."""
    rows = [(None, "lost words here"), (5, "same text twice"), (5, "same text twice"), (6, "first"), (6, "second text"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")
