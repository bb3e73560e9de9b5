"""The stages of the corpus pipeline, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
into the shared folder and reads it back for the next. All but the last return the columns of
documents, whatever other names the table has: rows travel as one struct column beside the few columns that an operator reads.
Each begins with the executors' memory collected, as their heaps have grown over the stage before.
The last stage's results cannot be said in SQL; tests compare the stages with brute force and exact round trips.

Nulls: a text without a letter (null too) is rejected by the first stage; a null language gets the
predicted one; other nulls pass. Ties and repeated rows: equal rows get equal decisions in every stage but the third, which keeps every row of
the document (by id) that stays. An empty table gives empty results at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.llm import langid, mixing, neardup, pieces, quality
from pipeweave.llm.common import Workspace, key_crc, release_executors

#: A public SentencePiece model, at the same path on every executor.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Mean out-of-place distance above which a text resembles no learned language (1: nothing in common), and what
#: a text of one letter may have besides (less in proportion to its letters). Held-out texts of sf0.01 lie at 0.10 to
#: 0.42, pieces of 5 to 600 characters of them at up to 0.67 (10 characters); random letters at 0.72 or more from 80 characters on.
STRANGE, SHORT = 0.6, 1.0
#: Quality below which a document is rejected.
POOR = 0.5
#: Share of all tokens that mixing keeps.
BUDGET = 0.8
#: Texts encoded together in the last stage: fewer than by default, as its workers have come from other stages.
TEXTS = 300


def _collected(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun with the executors' memory collected."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return begun


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row as ``row``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "lang", "source", "n_chars")


@_collected
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter or unlike every learned language; fill in missing languages.

    Null, empty and letterless texts go; a null id is never held out from learning; equal texts fare alike; without a
    row that has both text and language nothing is learned and all rows go.
    """
    model = langid.fit(docs.where(F.coalesce(key_crc("doc_id") % 5 != 0, F.lit(True))))
    found = langid.predict(_carried(docs), model)
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("lang_distance") <= STRANGE + SHORT / letters))
    return kept.withColumn("row", F.col("row").withField("lang", F.coalesce("lang", "lang_pred"))).select("row.*")


@_collected
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of poor quality.

    Null and empty texts are scored like any other; without labels of both kinds nothing is rejected; equal rows fare alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(_carried(docs), quality.fit(docs, labels))
    return scored.where(F.col("quality_score") >= POOR).select("row.*")


@_collected
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group.

    Documents without a word stay, and rows without an id; rows that share the id that stays all stay.
    """
    found = neardup.near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    kept = _carried(docs).join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")
    return kept.select("row.*")


@_collected
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents towards raked source, language and topic weights.

    Null sources and languages are values of their own; rows that share an id are drawn alike, rows without an id by one draw.
    """
    return mixing.mix(_carried(docs), budget=BUDGET, returned=["row"]).where("selected").select("row.*")


@_collected
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and two sampled segmentations beside them.

    Null and empty texts have no tokens and no samples; equal rows are sampled alike.
    """
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), PIECES, samples=2, rows=TEXTS)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_crc32", "decoded", "samples")


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage wrote is removed once the next one's result is written."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        space.keep(f"{k}-{name}")
    return docs
