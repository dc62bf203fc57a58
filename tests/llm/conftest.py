import pytest


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = "palabra larga " * 20_000
    rows = [(1, "der die das und nicht ein Haus", "de"), (1, "der die das und nicht ein Haus", "de"), (2, None, None), (3, "", "en"), (4, long, "es"), (None, "the house and the garden", "en"), (5, " \n\t ", None), (6, "12345 !!", "en"), (7, "x" * 50_000, None)]
    return spark.createDataFrame([(*r, "k", 0.5, True, [1], "row") for r in rows], "doc_id long, text string, lang string, keys string, score double, held_out boolean, ids array<int>, row string")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
