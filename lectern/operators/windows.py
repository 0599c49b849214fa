"""Window-shaped operators: neighbours, islands, running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def drop_adjacent_duplicates(rows: DataFrame, group: list[str], order: str, text: str, least: int = 4) -> DataFrame:
    """Rows with text, without those whose text repeats the row before.

    Texts are compared without white space and from `least` characters on. After a drop the
    previous key equals the dropped one, so looking one row back is enough.
    """
    full = rows.where(T.trim(F.col(text)) != "").withColumn("__key", T.without_space(F.col(text)))
    before = F.lag("__key").over(Window.partitionBy(*group).orderBy(order))
    repeat = (F.char_length("__key") >= least) & (F.col("__key") == F.coalesce("__before", F.lit("")))
    return full.withColumn("__before", before).where(~repeat).drop("__key", "__before")


def gap_groups(rows: DataFrame, group: list[str], order: str, start: Column, end: Column, gap: Column) -> DataFrame:
    """rows with `group_no`: a new group begins where start lies more than gap behind all ends before."""
    w = Window.partitionBy(*group).orderBy(order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (start - reach > gap), 1).otherwise(0)
    return rows.withColumn("__opens", opens).withColumn("group_no", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def bands(rows: DataFrame, group: list[str], at: str, ink: Column) -> DataFrame:
    """Runs of consecutive places with ink: first place and thickness of each."""
    inked = rows.where(ink)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*group).orderBy(at))
    return inked.withColumn("__island", island).groupBy(*group, "__island").agg(F.min(at).alias("start"), F.count("*").alias("thickness")).drop("__island")


def paragraph_ends(rows: DataFrame, group: list[str], order: str, end: str, glyph: Column, factor: float = 1.5) -> DataFrame:
    """rows with `paragraph_end`: the line stops more than factor glyphs before the widest, and isn't the last."""
    whole = Window.partitionBy(*group)
    last = F.lead(order).over(whole.orderBy(order)).isNull()
    short = F.max(end).over(whole) - F.col(end) > factor * glyph
    return rows.withColumn("paragraph_end", short & ~last & (glyph > 0))
