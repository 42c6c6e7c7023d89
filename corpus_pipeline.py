"""A corpus pipeline: toxicity, near copies, repeated spans, benchmark passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows of ``docs`` and returns a DataFrame.  All but the last return
the columns of ``documents``.  Their cases (nulls, empty texts, repeated rows,
empty tables) are those of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontaminate, jaccard, packing, substring, toxicity
from fleetscope.llm.common import stored, table, workers_import


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; null and empty texts stay.  Learns from labels outside the held-out fold."""
    workers_import(spark)
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=lambda i: ~toxicity.held_out(i))
    scored = toxicity.score(docs, model)
    return scored.filter((F.col("score") < 0.5) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select(*docs.columns)


#: Rows that Arrow hands to a Python worker at once, where the session says nothing else.  Documents
#: are long: with Spark's 10,000 a task holds tens of MB of text twice, in the JVM's buffers and in Python.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of similar documents stays."""
    workers_import(spark)
    _small_batches(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of 20 words that start earlier in the corpus go."""
    workers_import(spark)
    return substring.remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents placed in sequences."""
    import public_tokenizers

    workers_import(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack),
]

#: Tokenization and a trained model are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
