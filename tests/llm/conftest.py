import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, run string, row string, digest string, score string, n long, ids string, class string"
LONG = "Lorem ipsum dolor sit amet. " * 30_000


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", None, "x", None, "y", "z", None, 1, "q", None) for i, t, lang in rows], SCHEMA)


PLAIN = ("The committee of the town was asked for a report on the state of the roads and it was agreed that "
         "the work is to be done by the end of the year with the money that is left from the last one")
EDGES = [(5, None, "en"), (3, "", "en"), (7, "", None), (2, "the same text of two", "en"), (2, "the same text of two", "en"), (1, "the  same\ntext of two", "fr"),
         (None, "the same text of two", "en"), (None, None, None), (9, PLAIN, "en"), (8, PLAIN + " again", "en"), (10, "日本語 テキスト <|im_end|> \x00 <s>", "xx"),
         (11, LONG, "en"), (12, "x" * 70_000, "en"), (13, "   \n\t ", "en")]


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
