"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. The first four return the columns they were given, so any later stage could
follow; the last returns packed pieces. Null and empty texts are rejected by the first stage (no language) and would be by the
second (no words). An empty table passes through all stages. Extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from routelore.llm import language, mixing, packing, repetition, similar
from routelore.llm.queries import tokenizer_file
from routelore.llm.shared import table
from routelore.sources.staging import stage_table

#: A document is rejected if its language is undetermined or less certain than this.
LEAST_SCORE = 0.5
#: Documents are near-duplicates if their sets of shingles of so many words have at least this Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of texts sent to Python at a time. Spark's own 64 MB are held several times over by each task: in buffers of the JVM, which double
#: as they grow, as Arrow data, and as strings.
BATCH_BYTES = 4 << 20


def filtered(docs: DataFrame, needs: tuple[str, ...], operator, condition: str) -> DataFrame:
    """Rows that pass the condition on an operator's results; other columns are renamed meanwhile, so that none clashes."""
    names = {c: c if c in needs else f"__own_{i}" for i, c in enumerate(docs.columns)}
    found = operator(docs.withColumnsRenamed({c: n for c, n in names.items() if c != n})).where(condition)
    return found.selectExpr(*[f"`{n}` AS `{c}`" for c, n in names.items()])


def in_small_batches(stage):
    """The stage with batches of ``BATCH_BYTES``, a session setting that holds for what follows, as frames are worked out later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filtered(docs, ("doc_id", "text", "lang"), language.identified, f"lang_pred <> 'und' AND score >= {LEAST_SCORE}")


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filtered(docs, ("doc_id", "text"), repetition.quality, "kept")


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.deduplicated(docs, SHINGLE, SIMILARITY)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


@in_small_batches
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]
#: The models and the packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
