import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
#: Null, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve."), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "Ä ß 日本語 \U0001f600 mail a@b.co"),
    (7, "same text here with just a few words for everyone"), (8, "same text here with just a few words for everyone"), (8, "same text here with just a few words for everyone"), (None, "no id at all"), (9, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names operators use inside."""
    rows = [(i, t, "h", 1, [1], "s", True, 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, id int, spans array<int>, words string, kept boolean, fp int").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
