"""Gates, rule tables and dispatchers.

Every gate fails closed: an unknown condition counts as false.  A validator is a table of
errors, one row for each broken rule and key; a dispatcher ranks rules and the first hit sets
the status, while all hits fill their queues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(condition: Column | str) -> Column:
    """The condition (a column or SQL), where unknown is false."""
    return F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))


def all_hold(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, (holds(c) for c in conditions), F.lit(True))


def every(condition: Column) -> Column:
    """Aggregate: true over no rows, unknown rows count as false."""
    return F.coalesce(F.bool_and(holds(condition)), F.lit(True))


def errors(df: DataFrame, key: str, *rules: tuple[str, Column]) -> DataFrame:
    """``key, rule, priority`` for each rule broken; a rule is its code and what must hold."""
    found = F.array(*(F.when(~holds(ok), F.struct(F.lit(code).alias("rule"), F.lit(n).cast("long").alias("priority"))) for n, (code, ok) in enumerate(rules, 1)))
    return df.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select(key, "e.rule", "e.priority")


def first_error(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.min_by("rule", "priority").alias("rule"))


def accepted(keys: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A key passes only without errors."""
    counted = found.groupBy(key).agg(F.count("*").alias("errors"))
    return keys.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("errors", F.lit(0)).alias("errors"), F.col("errors").isNull().alias("acceptance_pass"))


def dispatch(df: DataFrame, key: str, rules: list[tuple[str, str, Column | str]], otherwise: str = "ready_for_strict_final_compare") -> DataFrame:
    """``key, status, repair_class, hits``: rules are (status, repair class, condition) in order of priority."""
    hit = F.filter(F.array(*(F.when(holds(c), F.struct(F.lit(s).alias("status"), F.lit(r).alias("repair_class"))) for s, r, c in rules)), lambda x: x.isNotNull())
    out = df.select(key, hit.alias("h"))
    return out.select(key, F.coalesce(F.get("h", F.lit(0))["status"], F.lit(otherwise)).alias("status"), F.get("h", F.lit(0))["repair_class"].alias("repair_class"), F.size("h").cast("long").alias("hits"))


def queues(df: DataFrame, key: str, rules: list[tuple[str, str, Column | str]]) -> DataFrame:
    """``repair_class, key`` for every rule that holds."""
    hit = F.filter(F.array(*(F.when(holds(c), F.lit(r)) for _, r, c in rules)), lambda x: x.isNotNull())
    return df.select(key, F.explode(hit).alias("repair_class"))


def queue_algebra(a: DataFrame, b: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """(a or b) without what is verified."""
    return a.select(key).union(b.select(key)).distinct().join(verified.select(key).distinct(), key, "left_anti")


def not_available(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Requested keys that do not exist; any row is a refusal."""
    return requested.select(key).distinct().join(available, key, "left_anti")


def count_state(raw: Column, extra: Column, converted: Column, left: Column) -> Column:
    """Whether the objects found explain the formulas there were."""
    gap = raw - converted
    return F.when(left > 0, "residual_officemath").when(gap == 0, "exact").when((extra > 0) & (gap == extra), "known_multisibling_collapse").when(gap > 0, "unexpected_formula_loss").otherwise("unexpected_formula_excess")


def source_state(foreign: Column, native: Column, converted: Column) -> Column:
    return F.when(foreign > 0, "blocked").when((native > 0) & (converted == 0), "ready_officemath").when((native > 0) & (converted > 0), "mixed").when(converted > 0, "already_axmath").otherwise("no_native_math")


def run_status(ok: Column, failed: Column) -> Column:
    return F.when((ok > 0) & (failed == 0), "ready").when(ok > 0, "partial").otherwise("blocked")


def structure_defects(expected: DataFrame, actual: DataFrame, key: str, metrics: list[str], exact: bool = False) -> DataFrame:
    """Metrics that differ (exact) or fall short (at least)."""
    both = expected.join(actual.select(key, *(F.col(m).alias(f"__{m}") for m in metrics)), key, "left")
    broken = [F.when(~holds(F.col(f"__{m}") == F.col(m) if exact else F.col(f"__{m}") >= F.col(m)), F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("expected"), F.col(f"__{m}").cast("long").alias("actual"))) for m in metrics]
    return both.select(key, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def review_errors(inventory: DataFrame, reviews: DataFrame, key: str, digest: str) -> DataFrame:
    """Duplicates, missing and extra reviews, stale hashes, and reviews that are not passed; unknown is not passed."""
    counted = reviews.groupBy(key).agg(F.count("*").alias("n"), F.min(digest).alias("low"), F.max(digest).alias("high"), F.count(digest).alias("known"), F.bool_and(holds(F.col("passed"))).alias("passed"))
    both = inventory.select(key, F.col(digest).alias("digest"), F.lit(True).alias("there")).join(counted, key, "full_outer")
    both_there = F.col("there").isNotNull() & F.col("n").isNotNull()
    # every review of a key must carry its hash
    same = F.col("digest").eqNullSafe(F.col("low")) & F.col("digest").eqNullSafe(F.col("high")) & (F.col("digest").isNull() | (F.col("known") == F.col("n")))
    return errors(
        both, key, ("duplicate", F.coalesce(F.col("n") <= 1, F.lit(True))), ("missing", F.col("n").isNotNull()), ("extra", F.col("there").isNotNull()),
        ("hash_mismatch", ~both_there | same), ("not_passed", ~both_there | holds(F.col("passed"))),
    ).drop("priority")


def inherited_first(styles: DataFrame, attribute: str, owner: list[str]) -> DataFrame:
    """For each style of an owner (a document), the attribute of the nearest ancestor, itself first, that has one.

    ``styles`` holds the owner's columns, ``style_id``, ``based_on`` and the attribute.  The styles of one owner
    are folded in one map; as many steps as it has styles end cycles, and a missing parent ends the search.
    """
    one = styles.groupBy(*owner, "style_id").agg(F.min(F.struct("based_on", F.col(attribute).alias("value"))).alias("style"))
    folded = one.groupBy(*owner).agg(F.map_from_entries(F.collect_list(F.struct("style_id", "style"))).alias("by"))

    def up(state: Column, _: Column) -> Column:
        parent = F.try_element_at("by", state["at"])
        return F.when(state["value"].isNotNull() | state["at"].isNull(), state).otherwise(F.struct(parent["based_on"].alias("at"), F.try_element_at("by", parent["based_on"])["value"].alias("value")))

    rows = folded.select(*owner, "by", F.explode("by").alias("style_id", "style"))
    start = F.struct(F.col("style_id").alias("at"), F.col("style.value").alias("value"))
    return rows.select(*owner, "style_id", F.aggregate(F.sequence(F.lit(1), F.size("by")), start, up)["value"].alias(attribute))


def label_counts(df: DataFrame, label: str, missing: str = "<missing>") -> DataFrame:
    named = F.coalesce(F.nullif(F.trim(F.col(label).cast("string")), F.lit("")), F.lit(missing))
    return df.groupBy(named.alias("label")).agg(F.count("*").alias("n"))


def performance_summary(batches: DataFrame, run: str = "run_id", slowest: int = 5) -> DataFrame:
    """Sums, shares and the slowest batches of each run; shares of nothing are 0, rates per nothing are null."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("seconds"), "batch"))
    ranked = batches.withColumn("rank", rank)
    total = F.sum("seconds") + F.sum("save_seconds")
    return ranked.groupBy(run).agg(
        F.sum("converted").alias("converted"), F.sum("seconds").alias("macro_seconds"), F.sum("save_seconds").alias("save_seconds"),
        F.coalesce(F.sum("seconds") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("macro_share"),
        (F.sum("seconds") / F.nullif(F.sum("converted").cast("double"), F.lit(0.0))).alias("seconds_per_item"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= slowest, F.struct("rank", "batch")))).alias("s"),
    ).withColumn("slowest", F.array_join(F.transform("s", lambda x: x["batch"].cast("string")), ",")).drop("s")


def latest_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Last state of each job; ties are settled by the later columns of ``order``."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("updates"))


def bad_transitions(events: DataFrame, key: str, state: str, order: list[str], allowed: DataFrame) -> DataFrame:
    """Steps between states that are not in ``allowed`` (from_state, to_state)."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    steps = events.select(key, *order, before.alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return steps.join(allowed, ["from_state", "to_state"], "left_anti")


def not_decreasing(batches: DataFrame, run: str, order: list[str], remaining: str) -> DataFrame:
    """Batches that left as much as or more than the one before."""
    before = F.lag(remaining).over(Window.partitionBy(run).orderBy(*order))
    return batches.withColumn("before", before).where(F.col(remaining) >= F.col("before"))
