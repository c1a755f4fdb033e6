"""Layout analytics on measured positions and widths (points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances in points, ratios and bands.
LEAST_SOURCE_WIDTH = 4.0
POOL = (0.1, 10.0)
LEAST_BAND, BAND_MADS, LEAST_REFERENCES = 0.04, 5.0, 3
SCALES = (0.25, 4.0)
SAME_LINE, BREAK_SPREAD, OVERFLOW = 1.5, 2.0, 2.0
TINY_WIDTH, BASELINE_RATIO, TALL_RATIO, WIDE = 10.0, 0.70, 2.8, 520.0


def width_outliers(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Ratios of final to source width far from the group's median.

    The pool of references keeps plausible ratios and needs three of them; every reliable ratio is
    tested, those outside the pool too.  Spread is the median absolute deviation, unscaled.
    """
    ratio = F.when(F.col("reliable") & (F.col("source_width") > LEAST_SOURCE_WIDTH), F.col("final_width") / F.col("source_width"))
    rows = pairs.withColumn("ratio", ratio)
    pool = rows.where((F.col("ratio") > POOL[0]) & (F.col("ratio") < POOL[1]))
    centre = pool.groupBy(*group).agg(F.median("ratio").alias("center"), F.count("*").alias("references")).where(F.col("references") >= LEAST_REFERENCES)
    spread = pool.join(centre.select(*group, "center"), group).groupBy(*group).agg(F.median(F.abs(F.col("ratio") - F.col("center"))).alias("mad"))
    known = centre.join(spread, group).withColumn("band", F.greatest(F.lit(LEAST_BAND), BAND_MADS * F.col("mad")))
    out = rows.join(known, group, "left")
    return out.withColumn("outlier", F.coalesce(F.abs(F.col("ratio") - F.col("center")) > F.col("band"), F.lit(False)))


def calibration(outliers: DataFrame) -> DataFrame:
    """What each outlier must be scaled by, where that is plausible; twentieths of a point round half to even."""
    scale = F.col("source_width") * F.col("center") / F.col("final_width")
    plan = outliers.where("outlier").withColumn("scale", scale).where(F.col("scale").between(*SCALES))
    return plan.withColumn("twips", F.bround(F.col("source_width") * F.col("center") * 20).cast("long"))


def same_line_groups(rows: DataFrame, within: list[str], order: list[str], y: str, tolerance: float = SAME_LINE, page: str | None = None, multi: str | None = None) -> DataFrame:
    """Neighbours on one line: each is compared with the first of its run, not with the one before.

    A row that itself spans lines ends the run and belongs to none; rows without a position are left
    out before.  One fold over each group's sorted array; a group is one paragraph.
    """
    fields = [F.col(c) for c in order] + [F.col(y).alias("y"), (F.col(page) if page else F.lit(0)).alias("page"), (F.col(multi) if multi else F.lit(False)).alias("multi")]
    rows = rows.where(F.col(y).isNotNull() & (F.col(page).isNotNull() if page else F.lit(True)))
    lists = rows.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    start = F.struct(F.lit(0).alias("group"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("int").alias("page"), F.array().cast("array<int>").alias("groups"))

    def step(s: Column, r: Column) -> Column:
        joins = ~r["multi"] & s["y"].isNotNull() & (r["page"].eqNullSafe(s["page"])) & (F.abs(r["y"] - s["y"]) <= tolerance)
        joins = F.coalesce(joins, F.lit(False))
        group = F.when(joins, s["group"]).otherwise(s["group"] + 1)
        return F.struct(
            group.alias("group"),
            F.when(r["multi"], F.lit(None)).when(joins, s["y"]).otherwise(r["y"]).cast("double").alias("y"),
            F.when(joins, s["page"]).otherwise(r["page"]).cast("int").alias("page"),
            F.concat(s["groups"], F.array(F.when(r["multi"], F.lit(None)).otherwise(group).cast("int"))).alias("groups"),
        )

    folded = lists.withColumn("groups", F.aggregate("rows", start, step, lambda s: s["groups"]))
    each = folded.select(*within, F.explode(F.arrays_zip("rows", "groups")).alias("e")).select(*within, *(F.col(f"e.rows.{c}").alias(c) for c in order), F.col("e.rows.y").alias(y), F.col("e.groups").cast("long").alias("line_group"))
    return each.where("line_group is not null")


def line_breaks(groups: DataFrame, final: DataFrame, within: list[str], key: str) -> DataFrame:
    """Lines of two or more whose members are missing, on several pages, or spread over more than before."""
    rows = groups.join(final, [*within, key], "left")
    out = rows.groupBy(*within, "line_group").agg(
        F.count("*").alias("members"), F.count_if(F.col("final_y").isNull()).alias("missing"), F.countDistinct("final_page").alias("pages"),
        (F.max("y") - F.min("y")).alias("source_spread"), (F.max("final_y") - F.min("final_y")).alias("final_spread"),
    )
    broken = (F.col("missing") > 0) | (F.col("pages") > 1) | F.coalesce(F.col("final_spread") > F.greatest(F.lit(BREAK_SPREAD), F.col("source_spread") + SAME_LINE), F.lit(False))
    return out.where("members >= 2").withColumn("broken", broken)


def right_overflow(x: Column, width: Column, text_right: Column, reliable: Column) -> Column:
    """How far an object reaches beyond the text; null where the bounds cannot be trusted."""
    return F.when(reliable, x + width - text_right)


def spans_lines(page: Column, end_page: Column, y: Column, end_y: Column) -> Column:
    same = (page == end_page) & (F.abs(end_y - y) <= SAME_LINE)
    return ~F.coalesce(same, F.lit(False))


def visual_width(page: Column, end_page: Column, y: Column, end_y: Column, x: Column, end_x: Column) -> Column:
    """Width of what lies on one line, with whether it is reliable."""
    width = F.when(~spans_lines(page, end_page, y, end_y) & (end_x >= x), end_x - x)
    return F.struct(width.alias("width"), F.coalesce(width > 0.5, F.lit(False)).alias("reliable"))


def anomaly_flags(height: Column, font: Column, width: Column, suspicious: Column) -> Column:
    flags = F.array(F.when(height / F.nullif(font, F.lit(0.0)) > TALL_RATIO, "too_tall"), F.when(width > WIDE, "too_wide"), F.when(suspicious, "suspicious_preview"))
    return F.filter(flags, lambda f: f.isNotNull())


def crop_box(x: Column, y: Column, width: Column, height: Column, pixels_per_point: Column, page_width: Column, page_height: Column, margin: float = 6.0) -> Column:
    """Pixel box around an object, kept inside the page; fractions are cut off."""
    left, top = F.greatest(x - margin, F.lit(0.0)), F.greatest(y - margin, F.lit(0.0))
    right, bottom = F.least(x + width + margin, page_width), F.least(y + height + margin, page_height)
    return F.struct(*((v * pixels_per_point).cast("int").alias(n) for v, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))


def baseline_groups(rows: DataFrame, within: list[str], ratio: Column, position: str, order: list[str]) -> DataFrame:
    """Paragraphs with any ratio above the limit, whole; the spread counts known positions only and needs two."""
    out = rows.groupBy(*within).agg(F.max(ratio).alias("max_ratio"), F.count("*").alias("members"), F.count(position).alias("known"), F.max(position).alias("hi"), F.min(position).alias("lo"))
    spread = F.when(F.col("known") >= 2, F.col("hi") - F.col("lo")).otherwise(F.lit(0.0))
    return out.where(F.col("max_ratio") > BASELINE_RATIO).select(*within, "max_ratio", "members", spread.alias("spread"))


def centre_drift(source: Column, final: Column, alignment: Column, tolerance: float = 3.0) -> Column:
    """Whether a centred object has moved by more than the tolerance."""
    return (alignment == 1) & (F.abs(final - source) > tolerance)


def line_segments(points: DataFrame, within: list[str], order: str) -> DataFrame:
    """Line number of each character position from its (page, y); positions that jump back are not monotone."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(order)
    before = F.lag(F.struct("page", "y")).over(w)
    now = F.struct("page", "y")
    points = points.withColumn("__new", F.coalesce((now != before).cast("int"), F.lit(1))).withColumn("__back", F.coalesce((now < before).cast("int"), F.lit(0)))
    return points.withColumn("line", F.sum("__new").over(w)).withColumn("monotone", F.sum("__back").over(Window.partitionBy(*within)) == 0).drop("__new", "__back")


def text_bounds(left: Column, right: Column, in_table: Column, columns: Column) -> Column:
    reason = F.when(in_table, "table_cell").when(columns > 1, "multi_column").when(right <= left, "empty_width")
    return F.struct(F.when(reason.isNull(), left).alias("left"), F.when(reason.isNull(), right).alias("right"), reason.alias("reason"))


def overwide(objects: DataFrame, sections: DataFrame, key: str = "doc_id", slack: float = 2.0) -> DataFrame:
    """Objects wider than the text, in documents of one section with one column, directly in the body."""
    plain = sections.groupBy(key).agg(F.count("*").alias("n"), F.max("columns").alias("columns"), F.max("text_width").alias("text_width")).where("n = 1 and columns = 1")
    return objects.join(plain.select(key, "text_width"), key).where(F.col("direct_body") & (F.col("width") > F.col("text_width") + slack))
