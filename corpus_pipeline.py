"""Corpus pipeline: language, near copies, benchmark leaks, mixing, shards.

Every stage takes all that the one before kept and returns the columns of ``documents``; the last adds the
shard and the slot.  Between stages the rows are written as Parquet to the shared folder and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import attach
from tabloom.llm.decontaminate import decontaminate
from tabloom.llm.language import UNKNOWN, identify
from tabloom.llm.mixing import mix_sources
from tabloom.llm.ngram_join import jaccard_components
from tabloom.llm.registry import table
from tabloom.llm.sharding import shard
from tabloom.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like(docs: DataFrame) -> list[str]:
    """The columns of ``documents``; others that a caller brought are not passed on."""
    return [c for c in COLUMNS if c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have, as the classifier tells.

    It rejects null texts and those without a letter (``und``), and texts that hold fewer known n-grams than any it learned from,
    as those in another script do.  Where nothing could be learned, because no document has a language, documents with a
    letter stay.
    """
    kept = _like(docs)
    found = identify(docs.select(*kept))
    if found.where(F.col("lang_pred") != UNKNOWN).isEmpty():
        return docs.select(*kept).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_known") >= 1)).select(*kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest id.

    Documents without an id or without words stay.  Of rows that repeat an id one stays, the one with the first text.
    """
    kept = _like(docs)
    groups = jaccard_components(docs.select(*kept))
    # A document goes if a smaller id leads its group.
    gone = stage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    left = attach(docs.select(*kept), gone, "doc_id", "left_anti", 16)
    several = stage(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "same-id")
    if several.isEmpty():
        return left
    repeated = attach(left, several, "doc_id", "left_semi", 16)
    first = repeated.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in kept if c not in ("doc_id", "text")])).alias("r"))
    once = first.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.{c}") for c in kept])
    return attach(left, several, "doc_id", "left_anti", 16).unionByName(once)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*_like(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; rows that repeat an id are taken alike."""
    kept = _like(docs)
    taken = mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies <> 1 AND doc_id IS NOT NULL")
    changed = attach(docs.select(*kept), stage(taken, "mix-copies"), "doc_id", "left", 24)
    times = F.coalesce("copies", F.lit(1))
    return changed.where(times > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), times))).select(*kept)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot``."""
    return shard(docs.select(*_like(docs)))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

#: Learned and iterative stages have no SQL; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
