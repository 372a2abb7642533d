import pytest

from precis.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    return {t: read(spark, SF, t).cache() for t in ("documents", "labels", "benchmark", "conversations", "pages")}


#: Columns whose names the operators use inside.
CLASHING = {"id": "1", "th": "2", "key": "x", "rid": "3", "n": "4", "spans": "s", "epoch": "5", "budget": "6", "score": "0",
            "_text": "t", "cid": "7", "kept": "k", "words": "w"}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    from pyspark.sql import functions as F

    long = "lorem ipsum dolor " * 30_000
    rows = [(1, "the quick brown fox jumps over the lazy dog and runs away", "en", "src1"), (2, None, None, None), (3, "", "en", "src2"),
            (None, "a text without an id that has some words", "en", "src1"), (4, long, "en", "src15"), (5, "x" * 50_000, "xx", "odd"),
            (6, " \n\t ", "de", "src1"), (7, "twin text of many equal words " * 20, "en", "src1"),
            (7, "twin text of many equal words " * 20, "en", "src1"), (8, "twin text of many equal words " * 20, "en", "src3"),
            (9, "é", "fr", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}).cache(), rows
