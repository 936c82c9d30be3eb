"""Index, stream and engine."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.models import OFFLINE, HashedWords, embedded, words_of
from docloom.operators import retrieval as rt
from docloom.operators.index import ChunkIndex
from docloom.plans.catalog import passages
from docloom.plans.engine import Engine, chat, console, printed
from docloom.sources.documents import file_count, ingest, manifest, page_counts, paths, pdf_files, read_chunks, unseen, write_chunks
from docloom.streaming.incremental import chunk_stream, index_stream

SF = "/root/testdata/sf0.001"


def some(spark):
    rows = passages(spark, SF).where("doc_id in ('doc_1', 'doc_2', 'doc_3', 'doc_5')")
    return rows.selectExpr("*", "cast(null as string) as prev_chunk_id", "cast(null as string) as next_chunk_id")


def test_index_adds_once_and_streams_are_safe_to_repeat(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    embed = lambda df: embedded(df, HashedWords())
    first = some(spark).where("doc_id = 'doc_1'")
    assert index.add(first, embed) == first.count()
    write_chunks(some(spark), str(tmp_path / "chunks"))
    total = read_chunks(spark, str(tmp_path / "chunks")).count()
    for k in range(2):
        index_stream(spark, str(tmp_path / "chunks"), index, embed, str(tmp_path / f"ck{k}")).awaitTermination()
        assert index.count() == total


def test_engine_answers_offline_with_sources(spark):
    engine = Engine(embedded(some(spark), HashedWords()))
    text = some(spark).first().text
    result = engine.query(" ".join(text.split()[:8]))
    assert result.answer == OFFLINE and 0 < len(result.chunks) <= 4 and "Question" in printed(result)
    assert len(engine.history) == 1


def plain_search(rows, question, engine):
    """The chunk ids that a question keeps, by plain loops over all chunks."""
    texts = [words_of(r["text"]) for r in rows]
    n, mean = len(rows), sum(map(len, texts)) / len(rows)
    df = Counter(t for words in texts for t in set(words))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = rt.EPSILON * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    asked = words_of(question)
    bm = [round(sum(idf.get(t, 0) * w.count(t) * (rt.K1 + 1) / (w.count(t) + rt.K1 * (1 - rt.B + rt.B * len(w) / mean)) for t in asked), 9) for w in texts]
    vectors = engine.embedder.encode(["passage: " + r["text"] for r in rows]).astype(float)
    q = engine.embedder.encode(["query: " + question])[0].astype(float)
    cos = [round(float(v @ q / math.sqrt((v @ v) * (q @ q))) if v @ v else 0.0, 9) for v in vectors]
    order = lambda scores: sorted(range(n), key=lambda i: (-scores[i], rows[i]["pos"]))[:50]
    dense, words = order(cos), order(bm)
    fused = {i: (1 / (dense.index(i) + 60) if i in dense else 0) + (1 / (words.index(i) + 60) if i in words else 0) for i in [*dense, *words]}
    best = sorted(fused, key=lambda i: -fused[i])[:50]
    share = lambda i: len(set(asked) & set(texts[i])) / len(set(asked))
    return [rows[i]["chunk_id"] for i in sorted(best, key=lambda i: -share(i))[:4]]


class Said:
    """A model that repeats its prompt's end and keeps all prompts."""

    def __init__(self):
        self.prompts = []

    def ready(self):
        return True

    def generate(self, prompt, limit, temperature):
        return "<think>so</think> short"

    def stream(self, prompt, limit):
        self.prompts.append(prompt)
        yield from ("<think>hm</think>", " an", " answer")


def test_engine_matches_plain_search_and_keeps_its_layout(spark):
    said = Said()
    engine = Engine(embedded(some(spark), HashedWords()), generator=said)
    rows = sorted((r.asDict(True) for r in engine.chunks.drop("embedding").collect()), key=lambda r: r["pos"])
    question = " ".join(rows[3]["text"].split()[:6])
    first = engine.query(question)
    assert [c["chunk_id"] for c in first.chunks] == plain_search(rows, question, engine)
    assert first.answer == "an answer" and list(first.latency) == ["hyde", "embed", "retrieval", "rerank", "generate"]
    kept = sorted(first.chunks, key=lambda c: c["chunk_id"])
    assert all(c["text"] in said.prompts[0] for c in kept) and said.prompts[0].startswith("### SYSTEM\n") and "CONVERSATION" not in said.prompts[0]
    engine.query(question, expand_context=True, window=1)
    assert f"=== CONVERSATION HISTORY ===\nQ: {question}\nA: an answer...\n\n=== CONTEXT ===\n### Source: " in said.prompts[1]
    assert said.prompts[1].endswith(f"\n\n=== QUESTION ===\n{question}\n\n=== ANSWER ===\n\n### ASSISTANT\n")
    near = engine.expand(first.chunks, 1)
    assert [(c["doc_id"], c["chunk_id"]) for c in near] == sorted((c["doc_id"], c["chunk_id"]) for c in near) and len(near) >= len(kept)
    first_view, last_view = chat(engine, question, [])
    assert first_view[0][-1] == {"role": "assistant", "content": ""} and last_view[0][-1]["content"] == "an answer" and first_view[1] == last_view[1] and f"**1. {first.chunks[0]['source_file']}**" in last_view[1]
    assert list(chat(engine, " ", [])) == [([], "")] and len(engine.history) == 3
    shown = list(console(engine, ["", "  ", "clear", "exit", question]))
    assert shown == ["History cleared."] and engine.history == [] and engine.query("  ").chunks == []


def pages():
    """A reader of files that are their pages, parted by form feeds; page `bad` cannot be read. A local class, so that it is sent to workers whole."""

    class Pages:
        def pages(self, content):
            if content == b"broken":
                raise RuntimeError("not a file of pages")
            return content.count(b"\f") + 1

        def cut(self, content, start, end):
            return b"\f".join(content.split(b"\f")[start:end])

        def markdown(self, content):
            if b"bad" in content:
                raise ValueError("bad page")
            return content.decode().replace("\f", "\n")

    return Pages()


def test_files_are_ingested_slice_by_slice(spark, tmp_path):
    (tmp_path / "in" / "more").mkdir(parents=True)
    page = lambda k: f"# Part {k}\nSome words on page {k} that are long enough to be kept as a chunk of their own, I hope."
    (tmp_path / "in" / "a b.pdf").write_text("\f".join(page(k) for k in range(45)))
    (tmp_path / "in" / "more" / "c.pdf").write_text("\f".join(page(k) if k != 30 else "bad" for k in range(41)))
    (tmp_path / "in" / "more" / "d.pdf").write_text("broken")
    folders = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "done")
    assert [r.path.rsplit("/")[-1].replace("%20", " ") for r in paths(pdf_files(spark, folders[0])).collect()] == ["a b.pdf", "c.pdf", "d.pdf"]
    counts = {r.source_file: (r.n_pages, r.error) for r in page_counts(pdf_files(spark, folders[0]), pages()).collect()}
    assert {k.replace("%20", " "): v for k, v in counts.items()} == {"a b.pdf": (45, None), "c.pdf": (41, None), "d.pdf": (None, "RuntimeError: not a file of pages")}
    failed = {(r.slice_start, r.error) for r in ingest(spark, *folders, pages()).collect()}
    assert failed == {(20, "ValueError: bad page"), (None, "RuntimeError: not a file of pages")}
    chunks = read_chunks(spark, folders[1])
    assert chunks.count() == 45 + 21 and file_count(chunks) >= 2
    assert {r.path.rsplit("/")[-1] for r in unseen(pdf_files(spark, folders[0]), manifest(spark, folders[2])).collect()} == {"d.pdf"}
    assert {r.slice_start for r in ingest(spark, *folders, pages()).collect()} == {None} and read_chunks(spark, folders[1]).count() == 66


def test_index_upserts_and_looks_up(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    embed = lambda df: embedded(df, HashedWords())
    rows = some(spark).where("doc_id in ('doc_1', 'doc_2')")
    n = rows.count()
    assert index.upsert(rows, embed) == n
    changed = rows.limit(2).withColumn("text", F.lit("changed words here"))
    assert index.upsert(changed, embed) == n and index.read().where("text = 'changed words here'").count() == 2
    ids = [r.chunk_id for r in changed.collect()]
    assert {r.chunk_id for r in index.get(ids).collect()} == set(ids) == {r.chunk_id for r in index.get(changed.select("chunk_id")).collect()}
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        ChunkIndex(spark, str(tmp_path / "none"), create=False)


def test_chunk_stream_takes_each_table_once(spark, tmp_path):
    body = "# A\n" + "Words that are long enough to be kept as a chunk, with more of them. " * 2
    rows = spark.createDataFrame([("d", "d.pdf", 0, body), ("e", "e.pdf", 0, body)], "doc_id string, source_file string, slice_start int, md string")
    for part in (rows.where("doc_id = 'd'"), rows.where("doc_id = 'e'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "md"))
        chunk_stream(spark, str(tmp_path / "md"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = read_chunks(spark, str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in got) == ["d", "e"] and all(r.section_path == ["A"] for r in got)
