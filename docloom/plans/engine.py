"""Questions over an index: rewrite, retrieve by both arms, fuse, rerank, widen, prompt, answer."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import CUT_OFF
from docloom.models import OFFLINE, Embedder, Generator, HashedWords, NoModel, Reranker, TokenCoverage, without_thoughts
from docloom.operators import context as cx
from docloom.operators import retrieval as rt
from docloom.sources.tables import scratch_dir

TOP_K, TOP_N, WINDOW, ANSWER_TOKENS, DRAFT_TOKENS = 50, 4, 0, 2048, 150
DRAFT = "Write a short technical passage that could answer this question. Passage only.\n\nQuestion: {}\n\nPassage:"
CHUNK = "qid int, rank int, doc_id string, source_file string, chunk_id string, section_path array<string>, text string"

SOURCE = "qid int, rank int, source_file string, section_path array<string>, heading string, rerank_score double, score double, has_table boolean, has_formula boolean, text string"


@dataclass
class Result:
    query: str
    answer: str
    chunks: list[dict]
    latency: dict[str, float] = field(default_factory=dict)

    @property
    def total(self) -> float:
        return sum(self.latency.values())


class Engine:
    """Over a table of chunks with embeddings, for one session's history. The keyword index is built at the start; each question searches once."""

    def __init__(self, chunks: DataFrame, embedder: Embedder | None = None, generator: Generator | None = None, reranker: Reranker | None = TokenCoverage(), index_dir: str | None = None):
        self.chunks = chunks.withColumn("pos", F.format_string("%s|%012d", "doc_id", "chunk_index"))
        self.embedder, self.generator, self.reranker = embedder or HashedWords(), generator or NoModel(), reranker
        self.keywords = rt.KeywordIndex.build(self.chunks, "pos", index_dir or f"{scratch_dir(chunks.sparkSession)}/keywords-{uuid.uuid4().hex}")
        self.history: list[tuple[str, str]] = []

    def rewrite(self, question: str) -> str:
        if not self.generator.ready():
            return question
        try:
            draft = without_thoughts(self.generator.generate(DRAFT.format(question), DRAFT_TOKENS, 0.3))
        except OSError:
            return question
        return draft if len(draft) >= 10 else question

    def embed(self, query: str) -> list[float]:
        return self.embedder.encode(["query: " + query])[0].tolist()

    def retrieve(self, query: str, vector: list[float], top_k: int = TOP_K) -> list[dict]:
        """The fused top_k as rows of the chunk table with score and rank, best first."""
        asked = self.chunks.sparkSession.createDataFrame([(0, query)], "qid long, text string")
        fused = rt.rrf(rt.dense_topk(self.chunks, "pos", "embedding", vector, top_k), self.keywords.search(asked, top_k), top_k)
        best = {r.pos: r for r in fused.collect()}  # top_k rows; their places go to the scan, so that the other chunks' columns are not made
        found = [r.asDict(True) | {"score": best[r.pos].score, "rank": best[r.pos]["rank"]} for r in self.chunks.drop("embedding").where(F.col("pos").isin(list(best))).collect()]
        return sorted(found, key=lambda c: c["rank"])

    def rerank(self, question: str, found: list[dict], top_n: int = TOP_N) -> list[dict]:
        """The top_n by the reranker's score, ties by rank; without a reranker, or without candidates, the first top_n."""
        if self.reranker is None or not found:
            return [c | {"rerank_score": None} for c in found[:top_n]]
        scores = self.reranker.predict(question, [c["text"] for c in found])
        scored = [c | {"rerank_score": float(s)} for c, s in zip(found, scores, strict=True)]
        return sorted(scored, key=lambda c: -c["rerank_score"])[:top_n]

    def expand(self, kept: list[dict], window: int) -> list[dict]:
        """The chunks and their neighbours, each once, by document and chunk id."""
        spark = self.chunks.sparkSession
        hits = spark.createDataFrame([(c["doc_id"], c["chunk_index"]) for c in kept], "doc_id string, chunk_index long")
        near = rt.neighbours(self.chunks.drop("embedding"), F.broadcast(hits), window)  # top_n rows and their neighbours
        return sorted((r.asDict(True) | {"score": 0.0, "rerank_score": None} for r in near.collect()), key=lambda c: (c["doc_id"], c["chunk_id"]))

    def context(self, kept: list[dict]) -> str:
        if not kept:
            return ""
        rows = [(0, i, c["doc_id"], c["source_file"], c["chunk_id"], c["section_path"], c["text"]) for i, c in enumerate(kept)]
        return cx.context(self.chunks.sparkSession.createDataFrame(rows, CHUNK)).first().context

    def sources(self, kept: list[dict]) -> str:
        """The chunks as a markdown list."""
        if not kept:
            return ""
        rows = [(0, i, c["source_file"], c["section_path"], c["heading"], c["rerank_score"], c["score"], c["has_table"], c["has_formula"], c["text"]) for i, c in enumerate(kept)]
        return cx.sources_markdown(self.chunks.sparkSession.createDataFrame(rows, SOURCE)).first().sources

    def prompt(self, question: str, context: str) -> str:
        turns = "\n".join(f"Q: {q}\nA: {a[:300]}...\n" for q, a in self.history[-cx.HISTORY :])
        told = f"{cx.HISTORY_MARK}\n{turns}\n" if turns else ""
        return f"{cx.SYSTEM_MARK}\n{cx.SYSTEM}\n\n{cx.USER_MARK}\n{told}{cx.CONTEXT_MARK}\n{context}\n\n{cx.QUESTION_MARK}\n{question}\n\n{cx.ANSWER_MARK}\n\n{cx.ASSISTANT_MARK}\n"

    def query(self, question: str, top_k: int = TOP_K, top_n: int = TOP_N, rewrite_query: bool = True, expand_context: bool = False, window: int = WINDOW) -> Result:
        """The answer with its chunks. Retrieval uses the rewritten query, reranking the question; the chunks returned are never widened. A blank question is not answered and leaves no trace."""
        if not question.strip():
            return Result(question, "", [])
        spent: dict[str, float] = {}

        def timed(name: str, made):
            began = time.time()
            out = made()
            spent[name] = time.time() - began
            return out

        search = timed("hyde", lambda: self.rewrite(question) if rewrite_query else question)
        vector = timed("embed", lambda: self.embed(search))
        found = timed("retrieval", lambda: self.retrieve(search, vector, top_k))
        kept = timed("rerank", lambda: self.rerank(question, found, top_n))
        told = self.expand(kept, window) if expand_context and window > 0 and kept else kept
        prompt = self.prompt(question, self.context(told))
        answer = timed("generate", lambda: self.answer(prompt))
        self.history = [*self.history, (question, answer)][-cx.HISTORY :]
        return Result(question, answer, kept, spent)

    def answer(self, prompt: str) -> str:
        if not self.generator.ready():
            return OFFLINE
        said = "".join(self.generator.stream(prompt, ANSWER_TOKENS))
        return CUT_OFF if "<think>" in said and "</think>" not in said else without_thoughts(said)

    def clear_history(self) -> None:
        self.history = []


def printed(result: Result) -> str:
    """What a console shows of a result."""
    lines = [f"Question: {result.query}", "", result.answer, ""]
    for i, c in enumerate(result.chunks, 1):
        path = " > ".join(c["section_path"] or []) or "-"
        rerank = "" if c.get("rerank_score") is None else f" rerank {c['rerank_score']:.3f}"
        lines.append(f"[{i}] {c['source_file']} | {path} | {c['score']:.4f}{rerank}")
    parts = ", ".join(f"{k} {v * 1000:.0f} ms" for k, v in result.latency.items())
    lines.append(f"{parts}; total {result.total:.2f} s")
    return "\n".join(lines)


def console(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """What a console answers to lines typed: `exit` ends, `clear` forgets the history, `norewrite ` before a question leaves it as it is, and blank lines say nothing."""
    for line in lines:
        typed = line.strip()
        word = typed.lower()
        if not typed:
            continue
        if word == "exit":
            return
        if word == "clear":
            engine.clear_history()
            yield "History cleared."
            continue
        plain = word.startswith("norewrite ")
        yield printed(engine.query(typed[len("norewrite ") :].strip() if plain else typed, rewrite_query=not plain))


def chat(engine: Engine, message: str, turns: list[dict], rewrite: bool = True) -> Iterator[tuple[list[dict], str]]:
    """(turns, sources) as a chat page shows them: when the sources are found, and when the answer is there. A blank message changes nothing."""
    if not message.strip():
        yield turns, ""
        return
    search = engine.rewrite(message) if rewrite else message
    kept = engine.rerank(message, engine.retrieve(search, engine.embed(search)))
    sources = engine.sources(kept)
    asked = [*turns, {"role": "user", "content": message}]
    yield [*asked, {"role": "assistant", "content": ""}], sources
    answer = engine.answer(engine.prompt(message, engine.context(kept)))
    note = f"*Searched for: `{search}`*\n\n" if search != message else ""
    engine.history = [*engine.history, (message, answer)][-cx.HISTORY :]
    yield [*asked, {"role": "assistant", "content": note + answer}], sources


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    session = SparkSession.builder.getOrCreate()
    for shown in console(Engine(session.read.parquet(sys.argv[1])), sys.stdin):
        print(shown)
