import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} filler{i % 31}" for i in range(30_000))
    same = "one and the same text that several rows share, word for word, line for line"
    rows = [
        (1, None, "en", "s", 1), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, same, "en", None, 5), (4, same, "en", None, 5), (5, same, "en", "s", None), (None, same, "en", "s", 9),
        (None, None, None, None, None), (6, long, "en", "s", len(long)), (7, "x", "en", "s", 1), (8, "İstanbul é中 \U0001f389 a\x00b \x85 ½", "tr", "s", 20), (9, "!!! ??? ...", "en", "s", 11), (10, "ａ" * 50, "zh", "s", 50),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
