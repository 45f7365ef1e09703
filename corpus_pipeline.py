"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.lineage import shared_folder
from srcatlas.llm import decontaminate, jaccard, langid, mixing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _bounded(spark: SparkSession) -> None:
    """Texts go to Python in small batches, so that what they take there doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def _measured(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: no text, or no letter. Models are learned from the stage's input."""
    _bounded(spark)
    model = langid.train(docs.where(langid.in_training()).select("text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    # with nothing to learn from, nothing is rejected
    return found.where((F.col("language.lang") != langid.UNKNOWN) | F.lit(not model.langs)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of texts whose five-word shingles are similar by 0.8 at least.

    SimHash finds the closest texts, bands of minimum hashes those that are too far apart
    for its fingerprints, and the exact similarity decides.
    """
    _bounded(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out, and drops documents that are mostly such passages."""
    _bounded(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.clean(docs.select(*COLUMNS), items), docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind."""
    _bounded(spark)
    return _measured(pii.redact(docs.select(*COLUMNS)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which it takes copies, with their number; languages keep their shares as far as the sources allow."""
    return mixing.mix(docs.select(*COLUMNS), cell="lang").where("copies > 0").drop("rate")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: Fingerprints, language models and boosted trees can't be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Each result lies in a folder of its own under spark.checkpoint.dir and goes once the
    next is written; the last one stays, as the rows returned are read from it. The
    session's options are afterwards as they were before.
    """
    options = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {o: spark.conf.get(o) for o in options}
    base, last = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for i, (name, stage) in enumerate(STAGES):
            at = f"{base}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(at)
            docs = spark.read.parquet(at)
            if last is not None:
                _delete(spark, last)
            last = at
    finally:
        for option, value in before.items():
            spark.conf.set(option, value)
    return docs
