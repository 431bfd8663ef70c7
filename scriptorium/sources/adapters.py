"""The engine's model laid over other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_text", T.StringType()),
        T.StructField("breadcrumb", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


FILE_IDS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_chunks(documents: DataFrame, indexed: bool = False) -> DataFrame:
    """Each document as a chunk of a file of its language and source, FILE_IDS ids to a file; facets language and scope.

    indexed adds chunk_index, which needs the rows of a file in one place.
    """
    scope = F.when(F.col("source") == "src0", "global-guide").when(F.col("source") == "src1", "").when(F.col("source") == "src2", "blog").otherwise("sdk-specific")
    filepath = F.concat(F.lit("sdk/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / FILE_IDS).cast("string"), F.lit(".md"))
    heading = F.concat(F.lit("Section "), (F.col("doc_id") % 7).cast("string"))
    out = documents.select(
        F.concat(filepath, F.lit("#"), F.col("doc_id").cast("string")).alias("chunk_id"),
        filepath.alias("filepath"),
        heading.alias("heading"),
        F.lit(2).alias("heading_level"),
        F.col("text").alias("content"),
        F.col("text").alias("content_text"),
        F.concat(filepath, F.lit(" > "), heading).alias("breadcrumb"),
        F.create_map(F.lit("language"), F.coalesce("lang", F.lit("")), F.lit("scope"), scope).alias("metadata"),
        "doc_id",
    )
    if indexed:
        out = out.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("filepath").orderBy("doc_id")) - 1).cast("int"))
    return out


def conversations_as_markdown(conversations: DataFrame) -> DataFrame:
    """A markdown file for each conversation: a title, then a section for each turn."""
    turn = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("md")))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: t["md"]), "\n\n")
    return turns.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))
