import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    base = [(i, f"Common passage number {i % 3} " + " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(60))) for i in range(30)]
    base += [(100, ""), (101, None), (102, " \n\t "), (103, "Éa ÀB ab"), (104, "éA Àb AB"), (105, "ÉA ÀB AB"), (106, "word " * 20000), (107, "x" * 3000), (None, "null id text here"), (None, None), (5, base[5][1]), (5, base[5][1])]
    rows = [(d, t, None if d is None or d % 5 == 0 else "en", None if d == 7 else f"src{(d or 0) % 3}", len(t or ""), "x", 1.0, 2) for d, t in base]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, n long")


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
