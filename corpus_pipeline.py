"""The corpus pipeline: documents through quality rules, a quality classifier, near-duplicates, a mix and encoding.

Each stage takes all that its predecessor kept and returns documents; only the last returns encoded texts. A stage's
function takes (spark, docs, sf_dir); ``run`` writes each stage's rows as Parquet into the cluster's shared folder
and gives them to the next as read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.mixing import mixed_documents
from tidelog.llm.pieces import encoded
from tidelog.llm.quality_model import good_documents
from tidelog.llm.quality_rules import clean_documents
from tidelog.llm.shared import stored, table, work_dir
from tidelog.llm.simhash import first_documents


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that they remove.

    Null and empty texts have no words and go. Equal rows share their verdict and stay as often as they are there. An
    empty table stays empty.
    """
    return clean_documents(docs)


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good, each row by its own text whatever its id.

    Null and empty texts get the score that zero features earn. Without labels of both kinds every score is their share
    (0.5 without any), so all rows stay or none. An empty table stays empty.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id (null last); rows that only share an id are no duplicates.

    Of equal rows one stays. Null and empty texts are copies of each other. An empty table stays empty.
    """
    return first_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each pass over a document the words that it takes.

    A document of which the mix takes nothing gives no row, as one without words; one that is taken in several passes
    gives a row for each, under the same id. Null is a source. An empty table stays empty.
    """
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text, with its score and whether it decodes to the text.

    A row for each row; a null or empty text has no ids and score 0. Of equal scores the longest last piece wins. An
    empty table gives no row.
    """
    import public_tokenizers

    ways = encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ways.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "score", "n_ways", "last_score", "ids_crc32", "same")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_model", quality_model_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The classifier, the fingerprints and the pieces are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
