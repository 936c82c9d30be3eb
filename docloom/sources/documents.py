"""Where documents come from and chunks go to: PDF folders, HTML pages, JSON lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.models import PdfReader
from docloom.operators.chunks import PAGES, chunk_markdown
from docloom.operators.index import CHUNK
from docloom.sources.tables import scratch


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, source_file and doc_id of all *.pdf below the folder. Rows come as files are read; paths() gives their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "content", name.alias("source_file"), tx.document_id(F.regexp_replace(name, r"(?i)\.pdf$", "")).alias("doc_id"))


def paths(files: DataFrame) -> DataFrame:
    """The paths alone, sorted; the contents are not read."""
    return files.select("path").orderBy("path")


def page_counts(files: DataFrame, reader: PdfReader) -> DataFrame:
    """doc_id, source_file, n_pages and error (null if the file could be opened)."""

    def one(content: bytes) -> tuple:
        try:
            return reader.pages(content), None
        except Exception as e:  # whatever the reader's library raises
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            made = [one(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source_file": pdf["source_file"], "n_pages": pd.array([m[0] for m in made], "Int64"), "error": [m[1] for m in made]})

    return files.select("doc_id", "source_file", "content").mapInPandas(run, "doc_id string, source_file string, n_pages long, error string")


def converted(files: DataFrame, reader: PdfReader, pages: int = PAGES) -> DataFrame:
    """path, doc_id, source_file, slice_start, md and error: a row for each slice of `pages` pages (files up to that long go whole). What fails has an error instead of md: a slice by itself, or a file that cannot be opened (slice_start null); the rest goes on."""

    def slices(content: bytes):
        try:
            n = reader.pages(content)
        except Exception as e:  # whatever the reader's library raises
            yield None, None, f"{type(e).__name__}: {e}"
            return
        for start in range(0, max(n, 1), pages):
            try:
                yield start, reader.markdown(content if n <= pages else reader.cut(content, start, min(start + pages, n))), None
            except Exception as e:
                yield start, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            for *named, content in zip(pdf["path"], pdf["doc_id"], pdf["source_file"], pdf["content"], strict=True):
                rows = [(*named, *made) for made in slices(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "doc_id", "source_file", "slice_start", "md", "error"]).astype({"slice_start": "Int64"})

    return files.select("path", "doc_id", "source_file", "content").mapInPandas(run, "path string, doc_id string, source_file string, slice_start int, md string, error string")


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page: headings, list items, code and paragraphs; scripts, styles, comments, menus and footers dropped. A stand-in for document conversion."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|title)\b.*?</\1>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?is)</?pre\b[^>]*>", "\n```\n")
    out = F.regexp_replace(out, r"(?is)</?(p|div|br|ul|ol|article|section|body|html|head)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"^\n|\n$", "")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines with explicit nulls, a folder per document (its name in column `doc`, so that doc_id stays in the lines)."""
    chunks.withColumn("doc", F.col("doc_id")).write.mode(mode).option("ignoreNullFields", "false").partitionBy("doc").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of all JSON-line files; raises if there is none."""
    found = spark.read.schema(CHUNK).option("recursiveFileLookup", "true").json(path)
    if found.isEmpty():
        raise RuntimeError(f"no chunks below {path}")
    return found


def file_count(chunks: DataFrame) -> int:
    """How many files hold the rows of a table that was read from files."""
    return chunks.select(F.col("_metadata.file_path").alias("file")).agg(F.countDistinct("file")).first()[0]


def unseen(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose path the manifest lacks; full paths, so files of one name in two folders both count."""
    return files.join(done.select("path"), "path", "left_anti")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the files done so far; none at first."""
    spark.createDataFrame([], "path string").write.mode("append").parquet(folder)
    return spark.read.schema("path string").parquet(folder)


def ingest(spark: SparkSession, folder: str, out: str, done: str, reader: PdfReader) -> DataFrame:
    """Chunk the files below the folder that the manifest lacks into JSON lines below out, and note them as done. Returns path and error of what failed; a file none of whose slices could be read is not noted, and so is tried again."""
    files = unseen(pdf_files(spark, folder), manifest(spark, done))
    made = scratch(converted(files, reader), "markdown")
    write_chunks(chunk_markdown(made.where("error is null")), out)
    made.where("error is null").select("path").distinct().write.mode("append").parquet(done)
    return made.where("error is not null").select("path", "slice_start", "error")
