"""The corpus pipeline, stage by stage, on a small table with odd rows."""

from collections import Counter

import pytest
from test_operators import components_by_hand, tiktoken_encoding
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import ngram_lm, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """The input of each stage, and the output of the last."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = base.where("n_chars > 1500").orderBy("doc_id").limit(3)
    odd = long.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("Anew. "), F.reverse("text")))  # no doc_id, texts of their own
    again = long.limit(2).withColumn("doc_id", F.lit(1).cast("long")).withColumn("text", F.concat("text", F.lit(" More.")))  # a doc_id that another text has
    empty = long.limit(2).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")).cast("string"))
    docs = base.unionByName(base.limit(20)).unionByName(odd).unionByName(again).unionByName(empty).withColumn("row_number", F.lit("clash"))
    at, out = tmp_path_factory.mktemp("stages"), []
    for k, (_, stage) in enumerate([("input", lambda s, d, _: docs), *corpus_pipeline.STAGES]):
        stage(spark, out[-1] if out else None, SF).write.parquet(str(at / str(k)))
        out.append(spark.read.parquet(str(at / str(k))))
    return out


def plain(df):
    return Counter(map(tuple, df.collect()))


def test_stages_keep_rows_and_columns(results):
    columns = results[0].columns
    assert all(df.columns == columns for df in results[:5]) and results[5].columns == ["doc_id", "n_tokens", "ids"]
    counts = [df.count() for df in results]
    assert all(counts) and counts[2] >= 0.7 * counts[0] and [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-duplicates", "mixing", "byte-level BPE"]


def test_rejecting_stages_follow_the_operators_verdicts(results, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by_model = ngram_lm.lm_quality(results[0], labels, carry=True).where("kept").select("row.*")
    by_rules = quality_rules.quality_rules(results[1], labels, carry=True).where("kept").select("row.*")
    assert plain(results[1]) == plain(by_model) and plain(results[2]) == plain(by_rules)
    assert not plain(results[1]) - plain(results[0]) and not plain(results[2]) - plain(results[1])


def test_one_row_of_each_group_stays(results):
    before, after = [r.text for r in results[2].collect()], Counter(r.text for r in results[3].collect())
    groups = components_by_hand(dict(enumerate(before)), 5)
    kept = Counter()
    for text, n in after.items():
        kept.update({groups[before.index(text)][1]: n})
    assert set(kept) == {g for _, g in groups.values()} and set(kept.values()) == {1}


def test_the_mix_takes_words_of_its_documents(results):
    sources = {}
    for r in results[3].collect():
        sources.setdefault((r.doc_id, r.source), []).append(r.text)
    for r in results[4].collect():
        words = r.text.split()
        assert any(" ".join(words) in " ".join(t.split()) or not Counter(words) - Counter(t.split()) for t in sources[r.doc_id, r.source])
        assert r.n_chars == len(r.text)
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert words(results[4]) > 1.2 * words(results[3])


def test_ids_are_the_librarys(results):
    encoding = tiktoken_encoding()
    want = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in results[4].collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in results[5].collect()) == want
    assert all(r.n_tokens == len(r.ids) for r in results[5].collect())
