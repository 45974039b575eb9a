"""Small column and frame helpers shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelflight.session import keep


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole`` scaled, 0.0 for an empty whole."""
    return F.when(whole > 0, part * F.lit(scale) / whole).otherwise(F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def hash_order(seed: int, *parts: Column) -> Column:
    """A repeatable shuffle key: same seed and ids, same order, on any number of executors."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key.

    ``row_number() = 1`` is planned with a group limit in front of the exchange, so each
    map task ships at most one row per key however many copies a key has.
    """
    return top_per_group(df, keys, order, 1).drop("_pos")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, position: str = "_pos"
) -> DataFrame:
    """At most ``k`` rows per key with their 1-based position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)


def folded_median(df: DataFrame, column: str) -> Column:
    """The exact median of counts, lengths or ratings as a scalar column.

    Values are first folded to (value, count) with map-side combining, so the single
    final task holds distinct values only, which are few by nature.
    """
    folded = _folded(df, column)
    return folded.agg(F.percentile("_v", F.lit(0.5), F.col("_n"))).scalar()


def exact_medians(df: DataFrame, columns: Sequence[str], cells: int = 4096) -> dict[str, float | None]:
    """Exact medians of several columns together, as doubles; None where a column holds no value.

    Selection by repeated histograms: a round is one scan for all columns, counting values in
    equal cells between the bounds of each open range.  The cell with the wanted rank, narrowed
    to its own least and greatest value, is the next range, so outliers cost a round at most;
    a range of one value is the answer.  No values are sorted, and only the chosen cells, two
    per column at most, reach the driver.  Nulls are left out; NaN counts as the greatest value.
    """
    names = {f"v{i}": c for i, c in enumerate(columns)}
    values = keep(df.select(*[F.col(c).cast("double").alias(v) for v, c in names.items()]), "medians")
    infinite = F.lit(math.inf)

    def ends(v: str) -> Column:
        finite = F.when(F.abs(v) < infinite, F.col(v))
        return F.struct(
            F.count_if(F.col(v) == -infinite).alias("below"), F.count(finite).alias("finite"),
            F.count_if(F.col(v) == infinite).alias("above"), F.count(v).alias("filled"),
            F.min(finite).alias("low"), F.max(finite).alias("high"),
        ).alias(v)

    first = values.agg(*[ends(v) for v in names]).first()
    found: dict[tuple[str, int], float] = {}
    wanted: dict[tuple[str, float, float], set[tuple[int, int]]] = {}
    for v in names:
        end = first[v]
        for place in {(end["filled"] - 1) // 2, end["filled"] // 2} if end["filled"] else ():
            inner = place - end["below"]
            if inner < 0:
                found[v, place] = -math.inf
            elif inner < end["finite"]:
                wanted.setdefault((v, end["low"], end["high"]), set()).add((place, inner))
            else:
                found[v, place] = math.inf if inner < end["finite"] + end["above"] else math.nan
    while wanted:
        ranges = list(wanted)
        cell = F.explode(F.array(*[
            F.struct(F.lit(at).alias("range"), _cell(F.col(v), low, high, cells).alias("cell"), F.col(v).alias("v"))
            for at, (v, low, high) in enumerate(ranges)
        ]))
        counted = values.select(cell.alias("c")).select("c.*").filter("cell IS NOT NULL").groupBy("range", "cell").agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        upto = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumn("after", F.sum("n").over(upto)).withColumn("before", F.col("after") - F.col("n"))
        holds = F.lit(False)
        for at, key in enumerate(ranges):
            for _, inner in wanted[key]:
                holds = holds | ((F.col("range") == at) & (F.col("before") <= inner) & (F.col("after") > inner))
        chosen = placed.filter(holds).collect()
        following: dict[tuple[str, float, float], set[tuple[int, int]]] = {}
        for row in chosen:
            key = ranges[row["range"]]
            for place, inner in wanted[key]:
                if row["before"] <= inner < row["after"]:
                    if row["low"] == row["high"]:
                        found[key[0], place] = row["low"]
                    else:
                        following.setdefault((key[0], row["low"], row["high"]), set()).add((place, inner - row["before"]))
        wanted = following
    out: dict[str, float | None] = {}
    for v, c in names.items():
        filled = first[v]["filled"]
        out[c] = (found[v, (filled - 1) // 2] + found[v, filled // 2]) / 2 if filled else None
    return out


def _cell(v: Column, low: float, high: float, cells: int) -> Column:
    """Number of the equal cell a value lies in, null outside the range."""
    width = high - low
    if width == 0:
        part = F.lit(0.0)
    elif math.isinf(width):
        part = (v / 2 - low / 2) / F.lit(high / 2 - low / 2)
    else:
        part = (v - low) / F.lit(width)
    return F.when((v >= low) & (v <= high), F.least(F.floor(part * cells).cast("int"), F.lit(cells - 1)))


def wide_median(df: DataFrame, column: str) -> Column:
    """The exact median of one continuous column as a scalar column."""
    return F.lit(exact_medians(df, [column])[column]).cast("double")


def _folded(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    return df.filter(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))


def banded(value: Column, edges: Sequence[int]) -> Column:
    """The half-open band [a, b) a value lies in, named by its edges; open above the last edge."""
    label = F.lit(None).cast("string")
    for low, high in zip(edges, list(edges[1:]) + [None], strict=True):
        name = f"[{low},{high})" if high is not None else f"[{low},inf)"
        label = F.when(value >= low, F.lit(name)).otherwise(label)
    return label
