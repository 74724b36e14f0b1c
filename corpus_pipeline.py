"""A corpus pipeline: toxic documents go, near copies go, personal data is masked, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder
and reads it again as the next stage's documents. All but the last stage return the columns of ``documents``.

In every stage texts of any length are used whole, rows that repeat an id are rows of their own unless a stage says
otherwise, other columns pass through untouched, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import merge_dropout, mixture, pii, severity, weighted_minhash
from tallyfold.llm.common import read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under the rejection grade; null and empty texts have none and stay."""
    return severity.keep_clean(docs, severity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest id of each near-duplicate class.

    Texts without words, null ones too, and rows without an id are classes of their own; of equal texts the smallest
    id stays; rows that repeat an id count as one document.
    """
    return weighted_minhash.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes the name of its kind; ``n_chars`` follows the text; null stays null."""
    columns = docs.columns
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that words of a document are taken; texts without words are never taken.

    Documents of a null source are a source; among equal rows a row number decides.
    """
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, pieces, n_pieces): the piece ids of each text, with merge-dropout; a null text has none.

    The ids decode to the text. Rows with equal id and text have equal pieces.
    """
    return merge_dropout.encode_column(docs.select("doc_id", "source", "text")).withColumn("n_pieces", F.size("pieces")).select("doc_id", "source", "pieces", "n_pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No stage but the masking of fixed patterns has an equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
