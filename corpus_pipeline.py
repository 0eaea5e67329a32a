"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, lines, mixing, packing, quality
from millrace.llm.common import discard, identified, materialize, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    names = ("__quality_score", "__quality_predicted")
    return quality.score(docs, model, names=names).where("__quality_predicted = 1").drop(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; none goes, though its text may become empty."""
    return lines.rewritten(docs, length_column="n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id; documents without words are no copies and stay.

    Rows that share an id but not the text are documents of their own, in the order of a hash; of equal ones one stays.
    Rows of a null id stay.
    """
    rows = identified(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    own = F.when((F.col("ta") == 0) & (F.col("tb") == 0), F.col("id")).otherwise(F.xxhash64("id", "ta", "tb"))
    rows = rows.select(F.when(F.col("doc_id").isNotNull(), own).alias("key"), "text", "row")
    groups = jaccard.join(rows.select(F.col("key").alias("doc_id"), "text"))
    kept = groups.where("component_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    out = rows.join(kept.hint("merge"), F.col("key").eqNullSafe(F.col("kept")), "left_semi")
    if _repeat(rows):
        out = out.where("key IS NOT NULL").dropDuplicates(["key"]).union(out.where("key IS NULL"))
    return out.select("row.*")


def _repeat(rows: DataFrame) -> bool:
    return bool(rows.groupBy("key").count().where("count > 1 AND key IS NOT NULL").limit(1).count())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; documents that it does not take go."""
    _, pieces = mixing.mix(docs)
    return mixing.mixed_documents(docs, pieces, length_column="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores, pseudorandom draws and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
