"""Spreadsheet grids as cell tables ``(file, sheet_ord, sheet, r, c, value, num)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import js_trim, number_text

SHEET = ["file", "sheet_ord"]


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """IO-8. The anchor value in every missing cell of its merged range."""
    spread = merges.select(
        *SHEET, "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("r"), "c1"
    ).select(*SHEET, "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    # Where ranges overlap the first one fills the cell.
    spread = spread.groupBy(*SHEET, "r", "c").agg(F.min(F.struct("r0", "c0")).alias("a"))
    anchors = cells.select(*SHEET, "sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), "value", "num")
    filled = (
        spread.select(*SHEET, "r", "c", "a.r0", "a.c0")
        .join(cells.select(*SHEET, "r", "c"), [*SHEET, "r", "c"], "left_anti")
        .join(anchors, [*SHEET, "r0", "c0"])
    )
    return cells.unionByName(filled.select(*cells.columns))


def grid_rows(cells: DataFrame) -> DataFrame:
    """IO-7. One row per grid row: ``cells`` from column 0 to its last filled one, blanks as ''.

    ``nums`` holds the numbers of numeric cells at the same places, whose text
    is the number's, or '' for zero.
    """
    number = F.when(F.col("value").isNull(), F.col("num"))
    text = F.coalesce(F.col("value"), F.when(F.col("num") != 0, number_text(F.col("num"))), F.lit(""))
    rows = cells.groupBy(*SHEET, "r").agg(
        F.max("sheet").alias("sheet"),
        F.max("c").alias("_last"),
        F.map_from_entries(F.collect_list(F.struct("c", F.struct(text.alias("v"), number.alias("n"))))).alias("_m"),
    )
    filled = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda c: F.try_element_at("_m", c))
    rows = rows.select(*SHEET, "sheet", "r", filled.alias("_cells"))
    return rows.select(
        *SHEET, "sheet", "r", F.transform("_cells", lambda x: F.coalesce(x["v"], F.lit(""))).alias("cells"),
        F.transform("_cells", lambda x: x["n"]).alias("nums"),
    )


def split_populated(cells: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO-9. Files with at least one filled cell, and the others with a reason."""
    filled = cells.filter("value is not null or num is not null").select("file").distinct()
    empty = files.select("file").join(filled, "file", "left_anti").withColumn("reason", F.lit("empty workbook"))
    return files.join(filled, "file", "left_semi"), empty


def cell_at(cells: Column, position: Column) -> Column:
    """Trimmed cell text, '' outside the row or at a missing column (position NULL or below 0)."""
    return js_trim(F.coalesce(F.when(position >= 0, F.get(cells, position)), F.lit("")))


def number_at(nums: Column, position: Column) -> Column:
    """The number of a numeric cell, NULL for text and outside the row."""
    return F.when(position >= 0, F.get(nums, position))
