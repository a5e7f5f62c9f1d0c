"""The training-data pipeline over ``documents``: quality, line dedup, near-dedup,
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``, with
``n_chars`` of the text as it is then; the last returns pieces of sequences. An
empty table passes through every stage. Rows are told apart by doc_id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelry.llm import decontaminate, line_dedup, near_dedup, packing, quality
from funnelry.llm.tasks import column, stored

#: The tokenizer's vocabulary file; every executor has it.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, ``row``: no operator's own column can clash with them."""
    return docs.select("doc_id", "text", F.struct(*[column(c) for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, but those that the stage has changed."""
    return done.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return _unpacked(quality.score(_carried(docs), model, accept=quality.ACCEPT), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines and of passages in one line go, and documents of which they leave nothing."""
    done = line_dedup.dedup_lines(_carried(docs))
    blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    return _unpacked(done.where(~(blank & (F.col("n_removed") > 0))), docs, n_chars=F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; of rows that
    share id and text, the one whose other columns have the smallest hash."""
    found = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), "version").distinct()
    rows = _carried(docs).withColumn("text_hash", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(found["id"]) & (rows["text_hash"] == found["version"])
    one = rows.join(found, same, "left_semi").groupBy("doc_id", "text_hash").agg(
        F.min_by(F.struct("text", "row"), F.xxhash64(F.to_json("row"))).alias("kept"))
    return _unpacked(one.select("kept.text", "kept.row"), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.find_leaks(_carried(docs), _table(spark, sf_dir, "benchmark"), whole_rows=True)
    return _unpacked(found.where("n_hit = 0"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096, as pieces of documents."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: The first stage is a trained model, so no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
