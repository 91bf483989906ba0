import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def text_of():
    return prose


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, copies, near copies, shared passages, repeats within a text."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "###", "one two three", "one two three", f"{prose(3, 50)} {passage} {prose(4, 50)}", f"{prose(5, 30)}\n{passage}", "a " * 400, "a " * 300, "ab" * 900, "x" * 5000, f"{prose(6, 8)}  {passage.upper()}  été ünï日本", prose(7, 20000, 3000), passage]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The same as a table with columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", 1) for i, t in odd_texts]
    return spark.createDataFrame(rows, DOCS + ", n int, grp string, component_id int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
