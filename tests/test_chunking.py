"""Chunking against plain Python statements of its rules."""

import types

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.arrow import BATCH, BYTES
from docloom.operators import segments as sg
from docloom.operators.blocks import heading_blocks, line_table, sub_blocks
from docloom.operators.chunks import chunk_markdown


def table_by_hand(text, limit=sg.MAX_CHARS):
    rows = [r for r in text.split("\n") if r.strip()]
    if len(rows) <= 2:
        return ["\n".join(rows)]
    out, cur, fresh = [], rows[:2], False
    for row in rows[2:]:
        cur = [*cur, row]
        fresh = len("\n".join(cur)) <= limit
        if not fresh:
            out.append("\n".join(cur))
            cur = rows[:2]
    return out + (["\n".join(cur)] if fresh else [])


def test_tables_split_with_their_header(spark):
    small = "|a|\n|-|"
    large = "\n".join(f"| {'x' * 90} {i} |" for i in range(40))
    long = "\n".join(f"| {'y' * (i * 37 % 300)} |" for i in range(400))
    rows = [(small,), (large,), ("|a|\n|-|\n\n|b|",), (long,), ("",), ("|a|\n|-|\n" + "|" + "z" * 2000 + "|",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(sg.table_pieces(F.col("t"))).collect()]
    assert got == [table_by_hand(t) for (t,) in rows]


def test_packing_follows_similarity_and_length(spark):
    sents = [f"Sentence number {i} " + "word " * (i % 30) + "ends." for i in range(60)]
    sims = [((i * 37) % 100) / 100 for i in range(59)]
    out, cur, n = [], sents[0], len(sents[0])
    for s, sim in zip(sents[1:], sims):
        if (sim < 0.4 and n > sg.SPLIT_FROM) or n + len(s) > sg.MAX_CHARS:
            out.append(cur)
            cur, n = s, len(s) + 1
        else:
            cur, n = cur + " " + s, n + len(s) + 1
    out.append(cur)
    df = spark.createDataFrame([(sents, sims)], "s array<string>, m array<double>")
    assert df.select(sg.packed(F.col("s"), F.col("m"), F.lit(0.4))).first()[0] == out


def test_small_pieces_join_the_one_before(spark):
    df = spark.createDataFrame([(["a" * 50, "b" * 300, "c" * 20, "d" * 199, "e" * 200],)], "p array<string>")
    assert df.select(sg.merged(F.col("p"))).first()[0] == ["a" * 50, "b" * 300 + " " + "c" * 20 + " " + "d" * 199, "e" * 200]


def test_headings_fences_and_junk(spark):
    md = "intro\n# A\ntext a\n```\n# not a heading\n---\n```\n#### D\n42\ntext d\n## B\n<!-- c -->\n\ntext b\n####### no"
    got = {r.block: (r.heading_stack, r.text) for r in heading_blocks(line_table(spark.createDataFrame([(1, md)], "doc_id long, md string"))).collect()}
    assert got == {0: ([], "intro"), 1: (["A"], "text a\n```\n# not a heading\n---\n```"), 2: (["A", "D"], "text d"), 3: (["A", "B"], "text b\n####### no")}


def test_sub_blocks_keep_fences_apart(spark):
    text = "one\n| a | b |\n| c | d |\n```\nx\n```\n```\ny\n```\ntwo"
    rows = sub_blocks(spark.createDataFrame([(1, 0, [], text)], "doc_id long, block long, heading_stack array<string>, text string")).orderBy("part").collect()
    assert [(r.kind, r.text) for r in rows] == [("text", "one"), ("table", "| a | b |\n| c | d |"), ("code", "```\nx\n```"), ("code", "```\ny\n```"), ("text", "two")]


def test_chunks_are_numbered_and_linked(spark):
    body = "A sentence about things that matter here. " * 4
    docs = [("d", "d.pdf", s, f"# H{s}\n{body}\n## Funding\n{body}\n## K\n{body}") for s in (0, 20)]
    rows = chunk_markdown(spark.createDataFrame(docs, "doc_id string, source_file string, slice_start int, md string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2, 3]
    assert [r.section_path for r in rows] == [["H0"], ["H0", "K"], ["H20"], ["H20", "K"]]
    assert [r.next_chunk_id for r in rows] == [r.chunk_id for r in rows[1:]] + [None]
    assert all(r.char_count == len(r.text) and r.chunk_id.startswith("d_000") for r in rows)


def test_lines_end_as_in_python(spark):
    texts = ["a\r\nb\rc\n", "x y\x85z", "", "end\n\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.lines(F.col("t"))).collect()]
    assert got == [t.splitlines() or [""] for t in texts]


class Lines:
    def split(self, text):
        return text.split("\n")


class Lengths:
    def encode(self, texts):
        return np.array([[len(t) % 7 + 1, len(t) % 5, 1] for t in texts], np.float64)


def test_chunks_by_models_with_overlap(spark):
    splitter, embedder = Lines(), Lengths()
    texts = ["\n".join(f"sentence {i} of {k} " + "word " * (i * k % 23) for i in range(1, 60)) for k in range(1, 5)] + ["short\ntext", "one line only " * 60]

    def by_hand(text, overlap):
        sents = text.split("\n")
        if len(sents) == 1 or len(text) <= 500:
            return [text] if len(text) >= 80 else []
        v = embedder.encode(sents)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        sims = (v[:-1] * v[1:]).sum(1)
        least, out, held, n = min(np.percentile(sims, 30), 0.75), [], [sents[0]], len(sents[0])
        for s, sim in zip(sents[1:], sims):
            if (sim < least and n > 300) or n + len(s) > 1200:
                out.append(" ".join(held))
                held = (held[-overlap:] if overlap else []) + [s]
                n = sum(len(x) + 1 for x in held)
            else:
                held.append(s)
                n += len(s) + 1
        done = []
        for piece in [*out, " ".join(held)]:
            if done and len(piece) < 200:
                done[-1] += " " + piece
            else:
                done.append(piece)
        return [p for p in done if len(p) >= 80]

    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    models = local(Lines), local(Lengths)
    for overlap in (0, 2):
        got = {r.k: r.pieces for r in sg.prose_pieces(rows, *models, overlap).collect()}
        assert got == {k: by_hand(t, overlap) for k, t in enumerate(texts)}


def local(kind):
    """An instance of a copy of the class that is sent to workers whole."""
    return type(kind.__name__, (), {k: types.FunctionType(f.__code__, {"np": np}) for k, f in vars(kind).items() if callable(f)})()


def test_tables_go_to_python_in_small_batches(spark):
    for key in (BATCH, BYTES):
        spark.conf.unset(key)
    rows = spark.createDataFrame([(i, "| head |\n" * 2 + f"| {'x' * 90} |\n" * 200) for i in range(1500)], "i long, t string").coalesce(1)
    made = rows.select(sg.table_pieces(F.col("t")).alias("p"))

    @F.pandas_udf("long")
    def held(part: pd.Series) -> pd.Series:
        return pd.Series([part.str.len().sum()] * len(part))

    assert rows.select(F.max(held("t"))).first()[0] < 6 << 20  # of 28 MB at once
    assert made.select(F.sum(F.size("p"))).first()[0] == 1500 * len(table_by_hand(rows.first().t))


class Few(Lengths):
    """Takes the sentences of small batches alone."""

    def encode(self, texts):
        if sum(len(t) for t in texts) > 6 << 20:
            raise ValueError("a large batch")
        return np.array([[len(t) % 7 + 1, len(t) % 5, 1] for t in texts], np.float64)


def test_sentences_go_to_python_in_small_batches(spark):
    for key in (BATCH, BYTES):
        spark.conf.unset(key)
    text = "\n".join(f"sentence {i} " + "word " * 20 for i in range(200))
    rows = spark.range(1000).select("id", F.lit(text).alias("text")).coalesce(1)
    made = sg.prose_pieces(rows, local(Lines), local(Few))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3  # split, compare, and pack with merge
    assert made.select(F.sum(F.size("pieces"))).first()[0] > 1000
