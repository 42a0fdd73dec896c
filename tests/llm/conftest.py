import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def make(n, seed=0):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns of clashing names."""
    long = prose(30_000, 1)
    rows = [
        (1, "", "en", "s"), (2, None, None, None), (3, "   \n\t ", "en", "s"), (4, long, "en", "s"), (5, long, "fr", "t"), (6, long + " end", "fr", "t"),
        (7, "one", "de", "t"), (7, "one", "de", "t"), (None, "null id text with a few words", "en", None), (8, "x" * 50_000, "en", "s"),
        (9, "ünïcödé 日本語 😀 text", "de", "s"), (10, "\x00\x01 control \x85 marks", "en", "s"), (11, "same words " * 400, "en", "s"), (12, "!!! ... ###", None, "s"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "h", "p", "r", 1, 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, path string, row string, fp long, h1 long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, 0, 0), (11, None, 1), (None, 1, 1), (7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
