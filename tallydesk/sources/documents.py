"""Documents: pages to text, text to sections, sections to searchable chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallydesk import rules, schemas
from tallydesk.functions.text import sections
from tallydesk.sources.tables import read_table

# A Spark string ends at 2^31 bytes and a section takes five of them ("\n1. A") at the least, so
# one document always has fewer sections than this.
MOST_SECTIONS = 2**29


def read_registry(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """What is known of each document: place, type, status, owner and title."""
    return read_table(spark, path, schemas.REGISTRY, source_format)


def read_pages(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PAGES, source_format)


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of a document in order, one per line; a null page is an empty line."""
    schemas.require(pages, "doc_id", "page_no", "text", frame="pages")
    return (
        pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("doc_id")
        .agg(F.expr("listagg(text, chr(10)) WITHIN GROUP (ORDER BY page_no)").alias("text"))
    )


def build_chunks(
    documents: DataFrame,
    registry: DataFrame,
    header: str = rules.SECTION_HEADER,
    order_by: str = "doc_ord",
) -> DataFrame:
    """One row per section with the registry entry of its document.

    ``chunk_ord``, a decimal wide enough for any 64-bit ``order_by``, orders chunks by document and
    then by place in it, and needs no global numbering. Two registered documents with the same
    ``order_by``, or two texts of one document, fail, as their chunks could not be told apart.
    """
    schemas.require(documents, "doc_id", "text", frame="documents")
    schemas.require(
        registry, "doc_id", "doc_type", "status", "account_id", "title", order_by, frame="registry"
    )
    alone = F.count(F.lit(1)).over(Window.partitionBy("_doc_ord")) == 1
    repeated = F.raise_error(F.concat(F.lit("several documents have the place "), F.coalesce(F.col("_doc_ord").cast("string"), F.lit("null"))))
    again = F.raise_error(F.concat(F.lit("several texts are of document "), F.col("doc_id").cast("string")))
    # Counted apart from the texts, which are not moved for it.
    texts = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_texts"))
    entries = (
        registry.select("doc_id", "doc_type", "status", "account_id", "title", F.col(order_by).cast("bigint").alias("_doc_ord"))
        .withColumn("_doc_ord", F.when(alone, F.col("_doc_ord")).otherwise(repeated.cast("bigint")))
        .join(texts, "doc_id")
        .withColumn("_doc_ord", F.when(F.col("_texts") == 1, F.col("_doc_ord")).otherwise(again.cast("bigint")))
        .drop("_texts")
    )
    return (
        documents.select("doc_id", "text")
        .join(entries, "doc_id")
        .select(
            "_doc_ord", "title", "doc_type", "status", "account_id", F.posexplode(sections(F.col("text"), header))
        )
        .select(
            (F.col("_doc_ord").cast("decimal(20,0)") * F.lit(MOST_SECTIONS) + F.col("pos")).cast("decimal(38,0)").alias("chunk_ord"),
            F.col("col.text").alias("text"),
            "title",
            "doc_type",
            "status",
            "account_id",
            F.col("col.section").alias("section"),
        )
    )
