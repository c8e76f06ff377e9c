"""The corpus pipeline: five stages over documents, each an operator of quillgrid.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, language_id, mixing, simhash, substring_dedup
from quillgrid.llm.common import discard, materialise, scratch, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or a letter go; all others stay, also ambiguous ones and where no label could be learnt."""
    model = language_id.fit(docs.filter(~language_id.held_out(3, 1)))
    found = language_id.predict(docs, model, carry=True)
    return found.filter(F.col("lettered")).select(*unpacked(found, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays, also where ids are null or repeat."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that an earlier document has go; documents of which nothing is left go too.

    Texts that lose nothing keep their white space.
    """
    found = substring_dedup.remove_repeats(docs, window=13, carry=True)
    found = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumnRenamed("kept", "text")
    out = found.select(*unpacked(found, docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up at least 5 % go."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, carry=True)
    return found.filter(~decontaminate.contaminated()).select(*unpacked(found, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in the order of the mix."""
    mixed = mixing.mix(docs, temperature=0.5, block=64)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: SQL can't express SimHash components or the schedule; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as made:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
            discard(made[:-1])  # the last folder is this stage's result; nothing reads the others any more
            del made[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
