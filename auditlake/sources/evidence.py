"""Tagged JSON evidence as typed tables: one schema for each tag; another tag is an error row, not an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Payloads by the kind of evidence (the tag's name without its vendor prefix), as DDL.
PAYLOADS = {
    "source-final-map/v1": "schema string, source_sha256 string, final_sha256 string, formula_count int, targets array<struct<target_id:string,kind:string,source_ordinal:int,source_anchor:string,expected_tex:string,final_ordinals:array<int>>>",
    "internal-tex-diagnostic/v1": "schema string, docx_sha256 string, scope string, success boolean, axmath_count int, exports array<struct<ordinal:int,success:boolean,axmath_exported_tex:string>>, failed array<string>",
    "class-e-review/v1": "schema string, source_sha256 string, rows array<struct<ordinal:int,source_omml_sha256:string,source_tex:string,axmath_exported_tex:string,decision:string,evidence:string>>",
    "visual-review/v2": "schema string, pages array<struct<page:int,image_sha256:string,passed:boolean>>",
    "conversion-checkpoint/v1": "schema string, source_sha256 string, working_sha256 string, remaining_omath int, last_batch int, status string",
    "geometry-audit/v2": "schema string, pairs array<struct<ordinal:int,ratio:double>>",
    "post-conversion-diagnosis/v2": "schema string, status string, repair_class string, queues map<string,array<int>>, next_actions array<string>",
}


def read_evidence(spark: SparkSession, path: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose tag ends in ``tag``, and ``path, schema`` of all others; a byte-order mark is dropped."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    found = texts.select("path", F.from_json("value", PAYLOADS[tag], {"mode": "PERMISSIVE"}).alias("e"), F.get_json_object("value", "$.schema").alias("tag"))
    good = F.coalesce(F.endswith("tag", F.lit(tag)), F.lit(False))
    return found.where(good).select("path", "e.*"), found.where(~good).select("path", F.col("tag").alias("schema"))


def write_new(df: DataFrame, path: str) -> None:
    """Evidence is never overwritten."""
    df.write.mode("errorifexists").json(path)
