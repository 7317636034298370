import pytest

#: Extra columns carry names that operators use inside.
ODD = "doc_id bigint, text string, source string, lang string, norm string, row_hi bigint, place int, c0 string, row string, fp bigint, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, "Hello World", "a"), (2, "hello world", "a"), (2, "hello world", "a"), (3, None, None), (4, "", "b"), (None, "HELLO world", "b"),
        (5, "É hello É", "b"), (6, "é hello é", "a"), (7, long, "a"), (8, long + " tail", "c"), (None, None, "c"), (9, " \t\n\x0b ", "c"), (10, "x", "a"),
    ]
    data = [(i, t, s, "en", "n", 1, 2, "c", "r", 3, len(t) if t is not None else None) for i, t, s in rows]
    return spark.createDataFrame(data, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
