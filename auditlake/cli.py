"""Verbs over packages and evidence.  Exit codes: 0 fine, 1 failed, 2 awaits review; of inspect 0 fine, 2 a package is blocked or cannot be read."""

from __future__ import annotations

import argparse
import math
import sys


def positive(value: str) -> int:
    number = int(value)
    if number < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return number


def tolerance(value: str) -> float:
    number = float(value)
    if not math.isfinite(number) or number < 0:
        raise argparse.ArgumentTypeError("must be finite and not negative")
    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="auditlake")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, about in (("inspect", "state of each package under a folder"), ("cache-analyze", "exact duplicates among formulas"), ("status", "latest evidence under a folder")):
        verbs.add_parser(verb, help=about).add_argument("folder")
    verbs.choices["cache-analyze"].add_argument("--least", type=positive, default=64)
    compare = verbs.add_parser("compare", help="two versions of packages, by name")
    compare.add_argument("source")
    compare.add_argument("working")
    query = verbs.add_parser("query", help="a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--out", help="folder for Parquet; it must not exist")
    return top


def listed(df, most: int = 1000) -> None:
    """Prints rows, and says so where there are more than are shown."""
    df.show(most, truncate=False)
    total = df.count()
    if total > most:
        print(f"the first {most} of {total} rows are shown")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from auditlake.operators import compare, duplicates
    from auditlake.plans import catalogue
    from auditlake.sources import packages

    spark = SparkSession.builder.appName("auditlake").getOrCreate()
    name = F.element_at(F.split("path", "/"), -1)
    if args.verb == "query":
        df = catalogue.queries()[args.name](spark, args.folder)
        df.write.mode("errorifexists").parquet(args.out) if args.out else listed(df, 50)
        return 0
    if args.verb == "status":
        tags = spark.read.text(args.folder, wholetext=True).select(F.get_json_object("value", "$.schema").alias("schema"), F.get_json_object("value", "$.status").alias("status"))
        listed(tags.groupBy("schema", "status").count().orderBy("schema", "status"))
        return 0

    def tokens(folder: str):
        return packages.tokens(packages.parts(packages.read_packages(spark, folder)))

    if args.verb == "inspect":
        parts = packages.parts(packages.read_packages(spark, args.folder))
        found = packages.document_states(parts, packages.tokens(parts)).select(name.alias("name"), "*").drop("path")
        listed(found.orderBy("name"))
        return 2 * int(not found.where("state in ('blocked', 'invalid', 'no_document')").isEmpty())
    if args.verb == "cache-analyze":
        formulas = tokens(args.folder).where("kind = 'math'")
        summary = duplicates.worth_caching(duplicates.duplicate_summary(formulas, "text"), args.least)
        summary.show()
        return int(not summary.first().allowed)
    texts = [packages.paragraph_texts(tokens(f)).where(F.col("story") == packages.MAIN).select(name.alias("doc_id"), F.col("p").cast("long").alias("p"), "plain") for f in (args.source, args.working)]
    gate = compare.content_gate(*texts)
    listed(gate.orderBy("doc_id"))
    return 2 if gate.where("state <> 'exact'").limit(1).count() == 0 else 1


if __name__ == "__main__":
    sys.exit(main())
