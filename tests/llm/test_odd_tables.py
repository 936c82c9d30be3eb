"""Every query on tables with nulls, repeated rows, very long texts and extra columns, and on empty ones."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import queries


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("odd")
    texts = [None, "", "a b c d e f", "a b c d e f g", "word " * 200_000, "word " * 200_000, "x" * 300_000, "\0 ퟿ \U0001f600 \t\x0b"]
    docs = [(k, t, lang, source, len(t or "")) for k, t, lang, source in zip([None, None, 1, 1, 2, 2, 3, 4], texts, [None, "en", "de"] * 3, [None, "s", "t"] * 3)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("bundle", "row", "size", "gram", "kept")}),
        "labels": spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(None, None, None), (1, "http://a.com/en/" + "x/" * 300, "<p>"), (1, "http://a.com/en/" + "x/" * 300, "<p>"), (2, "nonsense", "")], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "form")}),
    }
    for name, df in tables.items():
        df.write.parquet(f"{top}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/empty/{name}.parquet")
    return top, {name: df.count() for name, df in tables.items()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_and_empty_tables_keep_their_rows(spark, folders, name):
    top, counts = folders
    run = queries.queries()[name]
    rows = run(spark, f"{top}/full").collect()
    assert len(rows) == counts["pages" if "page_id" in rows[0] else "documents"]
    assert run(spark, f"{top}/empty").count() == 0
