"""The corpus pipeline: five stages over documents, each written as Parquet and read as the next one's input.

Every stage takes tables without rows, null ids and texts, empty and very long texts, repeated rows and
columns of any name, as its operator defines them; a null text is no document and goes with the quality rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import sentencepiece_codec
from auditlake.llm._frames import shared_folder, small, stored
from auditlake.llm.decontamination import decontaminate
from auditlake.llm.near_duplicates import near_duplicates, text_class
from auditlake.llm.quality_rules import quality_rules
from auditlake.llm.substring_dedup import remove_repeats

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and pairs of pieces, that a worker remembers; fewer than alone, as workers still hold what earlier stages left.
REMEMBERED = 1 << 16


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """Columns that no stage looks at under names that no operator uses, and how to name them back."""
    names = {c: c if c in ("doc_id", "text", "lang", "n_chars") else f"aside_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with the new text; n_chars follows it."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return changed.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    plain, back = _aside(docs)
    return quality_rules(plain).where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the row of the least id.

    Rows that repeat an id are each judged by their own text; of those of one group that have its least id, the one with
    the least hash of its text stays.  Rows without id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), detail=True).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows")).where("kept = 0 or rows > 1")
    ids = stored(ids, "judged")
    # what goes is less than what stays, so that the texts mostly stay where they lie; a null id matches nothing
    kept = docs.join(small(ids.select("doc_id")), "doc_id", "left_anti")
    repeated = ids.where("rows > 1 and kept > 0").select("doc_id")
    if repeated.isEmpty():
        return kept
    verdicts = found.where("kept").join(repeated, "doc_id").select(F.col("doc_id").alias("__id"), F.col("set_class").alias("__set"), F.col("root").alias("__root")).distinct()
    rows = docs.join(repeated, "doc_id", "left_semi").withColumn("__class", text_class(F.col("text"))).withColumn("__hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = rows.join(verdicts, (F.col("doc_id") == F.col("__id")) & F.col("__class").eqNullSafe(F.col("__set")))
    # a row without words is in no group but its own
    group = F.coalesce(F.col("__root").cast("string"), F.concat(F.col("__hash"), F.col("text").isNull().cast("string"))).alias("__group")
    one = judged.groupBy("doc_id", group).agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), "__hash").alias("__row"))
    return kept.unionByName(one.select("__row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document that was all repeats goes."""
    plain, back = _aside(docs)
    cut = remove_repeats(plain).where("n_removed = 0 or n_removed < n_words")
    return _with_text(plain, cut, "kept_text").select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test phrases are cut; a document that was nothing else goes."""
    plain, back = _aside(docs)
    clean = decontaminate(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0 or n_hit < n_words")
    return _with_text(plain, clean, "clean_text").select(*back)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return sentencepiece_codec.encode(docs.select("doc_id", "text"), TOKENIZER, held=REMEMBERED)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# The encoding stage cannot be put in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{n}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{n}")
    return docs
