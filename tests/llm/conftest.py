import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text."""
    rows = [
        (1, "hello world again and again", "en", "src1", 27), (1, "hello world again and again", "en", "src1", 27), (2, None, None, None, None), (None, "no id here", "en", "src0", 10),
        (3, "", "en", "src2", 0), (4, " \n\t ", "de", "x", 4), (5, "12345 !!!", "fr", "src9", 9), (6, "word " * 30_000, "en", "src1", 150_000), (7, "grüße aus köln \U0001f600", "de", "src1", 16),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def saved(tmp_path):
    def save(df, name):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return save


