"""From raw documents to token ids: toxic ones go, then those in no known language, copies, leaks; the rest is encoded.

Every stage works on all that its predecessor kept, and is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallydesk.llm import bpe, decontamination, langid, neardup, toxicity
from tallydesk.llm.common import staged, table, tokenizer_definition
from tallydesk.plans.checkpoints import passing_stages

# A text whose language is less probable than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the network, trained on the labels, does not predict to be toxic.

    Texts without words, null and empty ones too, go by the share of toxic labels, which is low.
    Whole texts count, however long; rows that repeat go or stay together. Columns keep their names
    and values, whatever they are called. Without documents or labels nothing goes.
    """
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_numbered(docs), network, text=_place(docs, "text"))
    return _back(scored.filter("predicted = 0"), docs)


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with letters whose language the model is sure enough of.

    Null and empty texts and texts without a letter go; a null ``lang`` teaches nothing but does not
    send a document away. Of equally probable languages the first by name counts. Rows that repeat
    go or stay together; columns keep their names and values.
    """
    model = langid.fit(docs)
    labelled = langid.predict(_numbered(docs), model, text=_place(docs, "text"))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _back(labelled.filter(sure), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its runs of five words.

    The one with the smallest id stays; of rows that repeat, one. Documents without words are like
    nothing and stay. Groups may be of any size, texts of any length.
    """
    return neardup.keep_one(docs, neardup.near_duplicates(docs, neardup.MinMax(width=5)))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Documents and items with null or empty text hold and are nothing. Rows that repeat go or stay
    together. Without items nothing goes.
    """
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.without_contaminated(docs, found)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with those of its columns that say where it is from.

    A null or empty text has none. Rows that repeat are all there; other columns are left out.
    """
    slim = docs.select("doc_id", "lang", "source", "text")
    ids = bpe.encode(slim, tokenizer_definition(), keep=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with columns by number, so that no name meets that of a score."""
    return docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])


def _place(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"c{n}" for n in range(len(docs.columns))]).toDF(*docs.columns)


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]

# Models, components and tokens are beyond SQL: tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder.

    What the stages write on their way goes with them; their own results stay until the last is read.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing_stages(spark):
            docs = staged(stage(spark, docs, sf_dir), name)
    return docs
