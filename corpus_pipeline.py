"""Pipeline over ``documents``: toxicity, near duplicates, contamination, secrets, mix.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.
All but the last return the columns of ``documents``.

NULL and empty texts pass every filter and are kept as they are; repeated rows count as
copies, of which the second stage keeps one (texts without words all stay); empty tables
stay empty; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgrid.llm import decontam, mixing, neardup, secrets, toxicity
from trackgrid.llm.common import Scratch

#: Fits, distances and scores are learned here, so no SQL states the rows; the test compares stage by stage.
ORACLE_SQL = None


#: Columns the stages read; all others are put aside under names that clash with nothing.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def filtering(stage: Callable) -> Callable:
    """A stage that returns the columns it was given, whatever their names."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c not in READ}
        kept = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return kept.select(*[aside.get(c, c) for c in docs.columns]).toDF(*docs.columns)

    return run_stage


@filtering
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0")


@filtering
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return neardup.keep_one(docs)


@filtering
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold too much of the benchmark."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated"))


@filtering
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text."""
    clean = secrets.scan_secrets(docs)
    changed = F.size("secret_spans") > 0
    out = {"text": F.when(changed, F.col("clean_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumns(out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many words it takes of each; texts without words are kept with none."""
    return mixing.mix(docs).where("taken > 0 or size = 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
