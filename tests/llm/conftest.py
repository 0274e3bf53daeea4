import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, record int, keep_id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, ties, repeated rows, a very long text, near and exact copies, and extra columns with clashing names."""
    base = " ".join(f"word{i} of the{i % 7}" for i in range(120))
    near = base.replace("word60", "other60")
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "short text"), (7, "a  b   c\n\n d <|endoftext|> x"), (7, "a  b   c\n\n d <|endoftext|> x"),
        (8, "ünïcödé 漢字 " * 50), (9, "x" * 5000), (10, "lorem ipsum dolor " * 12_000), (None, "no id here at all"), (11, base.upper()), (12, "\t\r \x1c mixed space\x00"),
    ]
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", None, "h", k, "k") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
