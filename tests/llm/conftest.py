import random

import pytest

LONG = "la " * 30_000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and copies."""
    rnd = random.Random(7)
    words = ["an", "the", "re", "tion", "onder", "élan", "stt", "ha", "ßen", "mit", "cc", "by"]
    text = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".\n"]) + str(rnd.randrange(50) if rnd.random() < 0.3 else "") for _ in range(n))
    base, other = text(120), text(90)
    near = base.split(" ")
    near[60] = "changed"
    passage = text(40)
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, "  \n\n "), (7, other), (7, other), (8, text(30) + passage + text(30)), (9, text(20) + passage + text(25)),
            (10, passage), (11, LONG), (12, LONG + "x"), (None, base), (None, None), (13, "a" * 300), (14, "b" + "a" * 300), (15, "one"), (16, "One "), (17, "a shared line here\nown\na shared line here"),
            (18, "\tA SHARED line here \nother"), (19, "ab\x00c ё 日本語 🙂🙂 <|endoftext|> x"), (20, base.upper()), (21, "\n".join([passage[:60], "x", passage[20:90]]))]
    rows += [(100 + k, base + f" tail{k}") for k in range(40)]
    rows += [(200 + k, f"w{k} " * 3 + passage + f" v{k}" * 3) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The rows as a table with clashing extra columns."""
    rows = [(i, t, "en", "s", len(t or ""), "c1", 1, "keys", 5) for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, keys string, start int").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
