"""A chunk index as Parquet: incremental append, upsert, and the null boundary of its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False), T.StructField("doc_id", T.StringType(), False), T.StructField("source_file", T.StringType()), T.StructField("chunk_index", T.LongType()),
        T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("heading", T.StringType()), T.StructField("text", T.StringType()), T.StructField("char_count", T.LongType()),
        T.StructField("has_table", T.BooleanType()), T.StructField("has_formula", T.BooleanType()), T.StructField("has_code", T.BooleanType()), T.StructField("prev_chunk_id", T.StringType()), T.StructField("next_chunk_id", T.StringType()),
    ]
)


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks whose id the index lacks, each id once."""
    return chunks.join(existing.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])


def upserted(stored: DataFrame, incoming: DataFrame, version: str = "version") -> DataFrame:
    """Rows by chunk_id, the largest version of each."""
    both = stored.unionByName(incoming)
    return both.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(version)))).where("r = 1").drop("r")


def to_metadata(chunks: DataFrame) -> DataFrame:
    """Nulls as '' and the section path as one string, as the store keeps them."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return chunks.select("chunk_id", "text", "doc_id", "source_file", F.col("chunk_index").cast("long").alias("chunk_index"), blank("heading"), tx.joined_path(F.col("section_path")).alias("section_path"), flag("has_table"), flag("has_formula"), flag("has_code"), blank("prev_chunk_id"), blank("next_chunk_id"))


def from_metadata(stored: DataFrame) -> DataFrame:
    null = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return stored.select("chunk_id", "text", "doc_id", "source_file", "chunk_index", null("heading"), tx.split_path(F.col("section_path")).alias("section_path"), "has_table", "has_formula", "has_code", null("prev_chunk_id"), null("next_chunk_id"))


class ChunkIndex:
    """An index directory: ids, documents, metadata and vectors in one Parquet table."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, path
        if create:
            spark.createDataFrame([], self.schema()).write.mode("append").parquet(path)
        else:
            spark.read.parquet(path)  # raises where there is no index

    @staticmethod
    def schema() -> T.StructType:
        return T.StructType([*[f for f in CHUNK.fields if f.name != "char_count"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(self.path)

    def ids(self) -> DataFrame:
        return self.read().select("chunk_id")

    def count(self) -> int:
        return self.read().count()

    def get(self, ids: list[str] | DataFrame) -> DataFrame:
        """The chunks of these ids: a short list goes to the scan as a filter, a table (chunk_id) is joined."""
        if isinstance(ids, DataFrame):
            return self.read().join(ids.select("chunk_id"), "chunk_id", "left_semi")
        return self.read().where(F.col("chunk_id").isin(ids))

    def add(self, chunks: DataFrame, embed) -> int:
        """Embed and append the chunks that are new; embed maps a DataFrame with text to one with embedding. Returns how many."""
        fresh = new_chunks(chunks, self.ids())
        before = self.count()
        columns = [f.name for f in self.schema().fields]
        embed(fresh).select(*columns).write.mode("append").parquet(self.path)
        return self.count() - before

    def upsert(self, chunks: DataFrame, embed) -> int:
        """Embed the chunks and put them in the place of those with their ids. The table is written anew beside the old one and then takes its place. Returns how many chunks the index holds."""
        columns = [f.name for f in self.schema().fields]
        incoming = embed(chunks.dropDuplicates(["chunk_id"])).select(*columns)
        both = upserted(self.read().withColumn("version", F.lit(0)), incoming.withColumn("version", F.lit(1)))
        both.select(*columns).write.mode("overwrite").parquet(f"{self.path}.next")
        jvm = self.spark.sparkContext._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (self.path, f"{self.path}.next"))
        files = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(new, old)
        return self.count()
