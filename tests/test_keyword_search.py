"""What a keyword index and its searches shuffle, and searches against plain loops."""

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.arrow import BATCH, BYTES
from docloom.models import HashedWords, words_of
from docloom.operators import retrieval as rt


def shuffled(spark):
    """Records that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


TEXTS = [" ".join(f"word{(i * j) % 60}" for j in range(1, 40 + i % 9)) if i % 50 else None for i in range(600)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    before = shuffled(spark)
    made = rt.KeywordIndex.build(docs, "doc_id", str(tmp_path_factory.mktemp("index")))
    return made, shuffled(spark) - before


def test_building_shuffles_terms_and_not_postings(index):
    made, moved = index
    assert made.documents.select(F.sum(F.size("terms"))).first()[0] > 10_000
    assert moved < 600 + 3 * 60 * 4  # the documents as they are dealt out above, and the terms of each task


def test_searches_shuffle_the_best_and_match_plain_loops(spark, index):
    made, _ = index
    asked = [f"word{i} word{i * 7 % 60} word1 word1" for i in range(30)] + ["nothing known", "", None]
    before = shuffled(spark)
    got = Counter(tuple(r) for r in made.search(spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "qid string, text string"), 5).collect())
    assert shuffled(spark) - before < 4000  # not 30 x 600 scores

    words = [words_of(t or "") for t in TEXTS]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(t for w in words for t in set(w))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = rt.EPSILON * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    want = Counter()
    for i, text in enumerate(asked):
        if terms := words_of(text or ""):
            scores = [round(sum(idf.get(t, 0) * w.count(t) * (rt.K1 + 1) / (w.count(t) + rt.K1 * (1 - rt.B + rt.B * len(w) / mean)) for t in terms), 9) for w in words]
            best = sorted(range(n), key=lambda d: (-scores[d], d))[:5]
            want.update((f"q{i}", d, scores[d], rank) for rank, d in enumerate(best))
    near = lambda rows: Counter((q, d, round(s, 7), r) for q, d, s, r in rows)
    assert near(got) == near(want)


def test_bags_are_made_in_small_batches(spark):
    for key in (BATCH, BYTES):
        spark.conf.unset(key)
    rows = spark.createDataFrame([(i, f"word{i % 7} " * 4000) for i in range(600)], "pos long, text string").coalesce(1)
    tokens = rows.select(tx.tokens(F.col("text")).alias("tokens"))
    bags = rt.hashed_bags(F.col("tokens"), 64)

    @F.pandas_udf("long")
    def held(part: pd.Series) -> pd.Series:
        return pd.Series([len(part) * 4000] * len(part))

    assert tokens.select(held("tokens")).distinct().orderBy(F.desc("held(tokens)")).first()[0] < 2_400_000  # of 600 rows at once
    assert {sum(r.bag) for r in tokens.select(bags.alias("bag")).collect()} == {4000}


def test_buckets_are_bounded(monkeypatch):
    monkeypatch.setattr(tx.Buckets, "MOST", 10)
    known = tx.Buckets(64)
    first = [known[f"w{i}"] for i in range(100)]
    assert len(known) <= 10 and [known[f"w{i}"] for i in range(100)] == first


def test_embedding_digests_each_token_once(monkeypatch):
    made = []
    digest = tx.hashlib.md5
    monkeypatch.setattr("hashlib.md5", lambda b: made.append(b) or digest(b))
    texts = ["Some words, some more words", "words a b", "", "more!"] * 50
    got = HashedWords(8).encode(texts)
    assert len(made) == 3
    for text, row in zip(texts, got, strict=True):
        counts = [0.0] * 8
        for t in words_of(text):
            counts[int(digest(t.encode()).hexdigest()[:8], 16) % 8] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1
        assert [round(c / norm, 5) for c in counts] == [round(float(x), 5) for x in row]
