"""Each query against its SQL in DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from docloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = ["doc_id_normalize", "tokenize", "strip_think", "hyde_fallback", "html_to_markdown_pages", "line_explode", "junk_filter", "heading_blocks", "skip_noise_sections", "subblock_segments", "sentence_split", "adjacent_similarity", "adaptive_threshold", "chunk_ids", "chunk_links", "page_slices", "index_new_chunks", "index_upsert", "index_metadata_roundtrip", "bm25_corpus_stats", "bm25_lexicon_idf", "bm25_zero_score_fill", "dense_topk", "dense_batch_topk", "l2_normalize", "hybrid_search", "rerank_topn", "expand_context", "build_context", "history_window", "build_prompt", "sources_markdown", "rewrite_notes", "table_split", "semantic_chunks", "chunk_table", "bm25_postings", "bm25_topk", "bm25_batch_topk"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(row):
    return repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = catalog.RUN[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(catalog.SQL[name])
    names = [d[0] for d in answer.description]
    place = [names.index(c) for c in columns]
    assert got == Counter(plain([r[i] for i in place]) for r in answer.fetchall())
