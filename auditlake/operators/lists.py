"""Numbers that list paragraphs show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 9


def list_numbers(paragraphs: DataFrame, levels: DataFrame, key: list[str]) -> DataFrame:
    """``number`` of each list paragraph (key, p, num_id, level) of a known level: nested levels start again behind a higher one.

    ``levels``: num_id, level, start, of the lists of each key.  Paragraphs without list, with list 0 or with a level that
    the list does not define are left out and do not interrupt it.
    """
    rows = paragraphs.where("num_id is not null and num_id <> '0'").join(levels.select(*key, "num_id", "level", "start", "format"), [*key, "num_id", "level"])
    ordered = Window.partitionBy(*key, "num_id").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # how many paragraphs of a higher level came so far, for each level
    higher = F.element_at(F.array(*(F.count_if(F.col("level") < k).over(ordered) for k in range(LEVELS))), F.col("level") + 1)
    since = Window.partitionBy(*key, "num_id", "level", "higher").orderBy("p")
    return rows.where(F.col("level").between(0, LEVELS - 1)).withColumn("higher", higher).withColumn("number", F.col("start") + F.row_number().over(since) - 1).select(*key, "p", "num_id", "level", "format", "number")
