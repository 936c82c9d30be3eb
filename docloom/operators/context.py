"""Context, history, prompt and source list, as grouped and ordered string aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

HISTORY = 4
#: What the model is told first.
SYSTEM = (
    "You are a research assistant who answers from excerpts of papers.\n"
    "- Use the context below and nothing else; name the file that each fact is from.\n"
    "- If the context does not hold the answer, say that you cannot find it in the documents.\n"
    "- Keep formulas, code, tables and technical terms as the source has them.\n"
    "- Set out long answers as bullet points or numbered steps.\n"
    "- Words like \"that\", \"it\" or \"this method\" may refer to earlier turns of the conversation.\n"
)
#: The marks that part a prompt, which models and other tools rely on.
SYSTEM_MARK, USER_MARK, ASSISTANT_MARK = "### SYSTEM", "### USER", "### ASSISTANT"
HISTORY_MARK, CONTEXT_MARK, QUESTION_MARK, ANSWER_MARK = "=== CONVERSATION HISTORY ===", "=== CONTEXT ===", "=== QUESTION ===", "=== ANSWER ==="


def in_order(*columns: str | Column) -> Column:
    """The last of the columns, collected in the order of the others, as an array."""
    named = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(columns)])
    return F.transform(F.array_sort(F.collect_list(named)), lambda x: x[f"k{len(columns) - 1}"])


def context(chunks: DataFrame, order_by: str = "chunk_id") -> DataFrame:
    """qid and context of ranked chunks (qid, rank, doc_id, source_file, chunk_id, section_path, text): a part per document, in the order first seen, its chunks by order_by."""
    section = F.concat(F.lit("["), tx.breadcrumb(F.col("section_path")), F.lit("]\n"), F.col("text"), F.lit("\n"))
    per_doc = chunks.withColumn("section", section).groupBy("qid", "doc_id").agg(F.min("rank").alias("seen"), F.min_by("source_file", "rank").alias("source_file"), F.array_join(in_order(order_by, "section"), "\n").alias("body"))
    part = F.concat(F.lit("### Source: "), F.col("source_file"), F.lit("\n"), F.col("body"))
    return per_doc.withColumn("part", part).groupBy("qid").agg(tx.strip(F.array_join(in_order("seen", "part"), "\n")).alias("context"))


def turns(messages: DataFrame) -> DataFrame:
    """session_id, turn, question, answer: a user's message that an assistant's follows directly."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return ahead.where("role = 'user' and next_role = 'assistant'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), "answer")


def history(all_turns: DataFrame, keep: int = HISTORY) -> DataFrame:
    """session_id and history: the last `keep` turns, answers cut, a blank line after each."""
    recent = all_turns.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where(F.col("r") <= keep)
    line = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), tx.cut_answer(F.col("answer")), F.lit("\n"))
    told = recent.withColumn("line", line).groupBy("session_id").agg(F.array_join(in_order("turn", "line"), "\n").alias("said"))
    return told.select("session_id", F.concat(F.lit(HISTORY_MARK + "\n"), F.col("said")).alias("history"))


def prompt(question: Column, told: Column, found: Column) -> Column:
    """System text, then history (null or empty: none), context, question and the mark for the answer."""
    before = F.when(F.coalesce(told, F.lit("")) != "", F.concat(told, F.lit("\n"))).otherwise("")
    head = f"{SYSTEM_MARK}\n{SYSTEM}\n\n{USER_MARK}\n"
    return F.concat(F.lit(head), before, F.lit(CONTEXT_MARK + "\n"), F.coalesce(found, F.lit("")), F.lit(f"\n\n{QUESTION_MARK}\n"), question, F.lit(f"\n\n{ANSWER_MARK}\n\n{ASSISTANT_MARK}\n"))


def rewrite_note(message: Column, search: Column) -> Column:
    """What a reader is shown of the rewritten query: nothing if it is the message itself."""
    return F.when(search != message, F.concat(F.lit("*Searched for: `"), search, F.lit("`*\n\n"))).otherwise("")


def sources_markdown(chunks: DataFrame) -> DataFrame:
    """qid and sources: a numbered list of ranked chunks with place, scores, labels and a snippet."""
    place = tx.breadcrumb(F.col("section_path"), " › ", F.coalesce("heading", F.lit("—")))
    labels = F.concat(F.when(F.col("has_table"), " · `table`").otherwise(""), F.when(F.col("has_formula"), " · `formula`").otherwise(""))
    score = F.when(F.col("rerank_score").isNotNull(), F.format_string("%.3f", "rerank_score")).otherwise(F.format_string("%.4f", "score"))
    entry = F.concat(F.lit("**"), (F.col("rank") + 1).cast("string"), F.lit(". "), F.col("source_file"), F.lit("** ("), score, F.lit(")"), labels, F.lit("\n*"), place, F.lit("*\n> "), tx.snippet(F.col("text")))
    return chunks.withColumn("entry", entry).groupBy("qid").agg(F.array_join(in_order("rank", "entry"), "\n\n").alias("sources"))
