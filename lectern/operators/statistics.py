"""Order statistics and image statistics on long-form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rounds in which values are narrowed to one of so many ranges before what is left is ordered.
ROUNDS, RANGES = 2, 1024


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str = "median", rounds: int = ROUNDS) -> DataFrame:
    """The element at place floor(n / 2) of the sorted values; nothing is interpolated."""
    counted = rows.groupBy(*keys, value).count()
    return _at_weight(counted, keys, value, F.floor(F.col("__total") / 2), name, rounds)


def weighted_upper_median(rows: DataFrame, keys: list[str], value: str, weight: str, least: int = 4, name: str = "median", rounds: int = ROUNDS) -> DataFrame:
    """The upper median with each value repeated `weight` times; null below `least` samples."""
    counted = rows.groupBy(*keys, value).agg(F.sum(weight).alias("count"))
    out = _at_weight(counted, keys, value, F.floor(F.col("__total") / 2), name, rounds, keep_total=True)
    return out.select(*keys, F.when(F.col("__total") >= least, F.col(name)).alias(name))


def top_share(rows: DataFrame, keys: list[str], value: str, share: float = 0.05, name: str = "top", rounds: int = ROUNDS) -> DataFrame:
    """The element at place floor(n * share) of the values from the largest on."""
    counted = rows.groupBy(*keys, value).count()
    return _at_weight(counted, keys, value, F.floor(F.col("__total") * share), name, rounds, descending=True)


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """a joined with b on equal columns, nulls included."""
    other = b.withColumnsRenamed({c: f"__b_{c}" for c in columns})
    return a.join(other, [a[c].eqNullSafe(other[f"__b_{c}"]) for c in columns]).drop(*[f"__b_{c}" for c in columns])


def _at_weight(counted: DataFrame, keys: list[str], value: str, place: Column, name: str, rounds: int, descending: bool = False, keep_total: bool = False) -> DataFrame:
    """The value in whose span of the cumulated counts a place lies.

    Equal values are counted first. In each round the values of a key are counted by ranges of
    equal width between their least and largest; only the range that holds the place is kept. The ranges
    of a key are few rows, so a key with all rows is counted by all tasks, and a window orders
    nothing but the last range. Nulls come before the least value; values that aren't finite aren't narrowed.
    """
    rows = counted.withColumn("__v", F.col(value).cast("double") * (-1 if descending else 1))
    total = counted.groupBy(*keys).agg(F.sum("count").alias("__total"))
    state = total.withColumn("__before", F.lit(0).cast("long"))
    for _ in range(rounds):
        ends = rows.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        width = F.col("__high") - F.col("__low")
        share = F.floor((F.col("__v") - F.col("__low")) / width * RANGES)
        part = F.when((width > 0) & (width < float("inf")), F.coalesce(F.least(share, F.lit(RANGES - 1)), F.lit(-1))).otherwise(F.lit(0))
        dealt = _same(rows, ends, keys).withColumn("__part", part).drop("__low", "__high")
        sums = dealt.groupBy(*keys, "__part").agg(F.sum("count").alias("__n"))
        w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
        upto = _same(sums, state, keys).withColumn("__upto", F.col("__before") + F.sum("__n").over(w))
        held = upto.where((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__n")))
        held = held.select(*keys, "__part", "__total", (F.col("__upto") - F.col("__n")).alias("__before"))
        rows = _same(dealt, held.select(*keys, "__part"), [*keys, "__part"]).drop("__part")
        state = held.drop("__part")
    last = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_first() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = _same(rows, state, keys).withColumn("__upto", F.col("__before") + F.sum("count").over(last))
    hit = placed.where((place < F.col("__upto")) & (place >= F.col("__upto") - F.col("count")))
    return hit.select(*keys, F.col(value).alias(name), *(["__total"] if keep_total else []))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """0.299 r + 0.587 g + 0.114 b, cut to an integer."""
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def histogram(rows: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    return rows.groupBy(*keys, bin_).count()


def otsu(counts: DataFrame, keys: list[str], bin_: str = "bin", count: str = "count", default: int = 127) -> DataFrame:
    """The bin that splits a histogram with the largest between-class variance; the lowest of ties.

    Works on bin counts, so the windows run over at most 256 rows for each image.
    """
    w = Window.partitionBy(*keys)
    run = w.orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.sum(count).over(w), F.sum(F.col(bin_) * F.col(count)).over(w)
    back, sum_back = F.sum(count).over(run), F.sum(F.col(bin_) * F.col(count)).over(run)
    v = counts.select(*keys, bin_, n.alias("n"), total.alias("total"), back.alias("wb"), sum_back.alias("sb"))
    front = F.col("n") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("total") - F.col("sb")) / front
    v = v.withColumn("between", F.when(front > 0, F.col("wb").cast("double") * front * gap * gap).otherwise(F.lit(0.0)))
    best = F.row_number().over(w.orderBy(F.desc("between"), bin_))
    return v.withColumn("__n", best).where("__n = 1").select(*keys, F.when(F.col("between") > 0, F.col(bin_)).otherwise(F.lit(default)).cast("int").alias("threshold"))


def polarity(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean brightness of an image and whether its ink is dark."""
    mean = F.avg((F.col("r") + F.col("g") + F.col("b")) / 3)
    return pixels.groupBy(*keys).agg(mean.alias("mean"), (mean >= 128).alias("dark_ink"))


def border_mean(pixels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Mean colour of the outermost pixels; corners lie on two sides and count twice."""
    sides = (F.col("x").isin(0, width - 1)).cast("int") + (F.col("y").isin(0, height - 1)).cast("int")
    edge = pixels.withColumn("__n", sides).where("__n > 0")
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("__n")) / F.sum("__n") + 0.5).cast("int").alias(c)
    return edge.groupBy(*keys).agg(mean("r"), mean("g"), mean("b"))


def is_ink(margin: float = 30.0) -> Column:
    """Whether the plain mean of a pixel's colours is far enough from that of its image (mean, dark_ink)."""
    plain = (F.col("r") + F.col("g") + F.col("b")) / 3
    return F.when(F.col("dark_ink"), plain < F.col("mean") - margin).otherwise(plain > F.col("mean") + margin)


def ink_profile(pixels: DataFrame, keys: list[str], means: DataFrame, at: str, size: int, margin: float = 30.0) -> DataFrame:
    """Ink pixels of each row or column (`at`), with zeros where there are none."""
    ink = is_ink(margin)
    counted = pixels.join(means, keys).groupBy(*keys, at).agg(F.count(F.when(ink, 1)).alias("ink"))
    grid = means.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(at))
    return grid.join(counted, [*keys, at], "left").select(*keys, at, F.coalesce("ink", F.lit(0)).alias("ink"))


def grid_scores(pixels: DataFrame, keys: list[str], ink: Column, cell: int = 40) -> DataFrame:
    """Ink transitions of each grid cell along every second row; cells too empty or too full are out."""
    rows = pixels.where(F.col("y") % 2 == 0).withColumn("__ink", ink)
    rows = rows.withColumn("cx", F.floor(F.col("x") / cell).cast("int")).withColumn("cy", F.floor(F.col("y") / cell).cast("int"))
    before = F.lag("__ink", 1, False).over(Window.partitionBy(*keys, "cy", "y", "cx").orderBy("x"))
    out = rows.withColumn("__turn", (F.col("__ink") != before).cast("int")).groupBy(*keys, "cx", "cy").agg(F.sum("__turn").alias("turns"), F.sum(F.col("__ink").cast("int")).alias("inked"))
    ratio = F.col("inked") / (cell * cell / 2)
    return out.select(*keys, "cx", "cy", F.when((ratio > 0.03) & (ratio < 0.6), F.col("turns")).otherwise(F.lit(0)).alias("score"))


def best_patch(cells: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """The window of width x height cells with the largest score, the first by rows of ties; none if not positive."""
    across = Window.partitionBy(*keys, "cy").orderBy("cx").rangeBetween(0, width - 1)
    rows = cells.withColumn("__s", F.sum("score").over(across)).withColumn("__w", F.count("*").over(across))
    down = Window.partitionBy(*keys, "cx").orderBy("cy").rangeBetween(0, height - 1)
    sums = rows.withColumn("total", F.sum("__s").over(down)).withColumn("__h", F.count("*").over(down)).withColumn("__full", F.min("__w").over(down))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "cy", "cx"))
    whole = sums.where((F.col("__full") == width) & (F.col("__h") == height) & (F.col("total") > 0))
    return whole.withColumn("__n", first).where("__n = 1").select(*keys, "cx", "cy", "total")
