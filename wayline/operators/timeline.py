"""Ordered logic over long series without putting a device in one task.

A device may hold a third of all rows. Rows are therefore ordered within slices of an
hour, (device_id, slice). What a slice needs from its neighbours comes as guests: rows of
the last seconds of a slice also go to the next one, so that a series is read and shuffled
once. Runs are numbered within slices; those that go on over a border are merged from a
table of one row for each run and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.constants import CONTIGUOUS_MS

SLICE_MS = 3_600_000


def slice_of(t_ms: str = "t_ms") -> Column:
    return F.floor(F.col(t_ms) / SLICE_MS)


def sliced(df: DataFrame, back_ms: int = CONTIGUOUS_MS, ahead_ms: int = 0) -> DataFrame:
    """df with _slice and _own; rows of the last back_ms of a slice also stand in the next, those of the first ahead_ms in the one before, not as its own."""
    at, into = slice_of(), F.pmod(F.col("t_ms"), F.lit(SLICE_MS))
    places = F.array_compact(F.array(at, F.when(into >= SLICE_MS - back_ms, at + 1), F.when(into < ahead_ms, at - 1)))
    return df.withColumn("_slice", F.explode(places)).withColumn("_own", F.col("_slice") == slice_of())


def ordered(key: tuple[str, ...] = ("device_id",)) -> WindowSpec:
    return Window.partitionBy(*key, "_slice").orderBy("t_ms", "protocol")


def with_previous(df: DataFrame, columns: list[str], name: str = "prev", key: tuple[str, ...] = ("device_id",), within_ms: int = CONTIGUOUS_MS) -> DataFrame:
    """df with a struct of the columns of the key's row before, by (t_ms, protocol), and _slice.

    The first row of a slice has null if the row before is more than within_ms older; other
    rows have their row before whatever its age. Rows stay partitioned by (key, _slice).
    """
    df = sliced(df, within_ms).withColumn("_self", F.struct(*columns))
    return df.withColumn(name, F.lag("_self").over(ordered(key))).where("_own").drop("_self", "_own")


def with_runs(df: DataFrame, new: Column, key: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """df (with _slice, as with_previous leaves it) with _run, the number of new runs in the slice so far: 0 goes on from the slice before."""
    return df.withColumn("_run", F.sum(new.cast("bigint")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))


def run_number(key: tuple[str, ...] = ("device_id",)) -> Column:
    """Over one row for each (key, _slice, _run): the number of the whole run."""
    return F.sum((F.col("_run") > 0).cast("bigint")).over(Window.partitionBy(*key).orderBy("_slice", "_run"))


def with_rank(df: DataFrame, name: str, total: str, key: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """df with the number of its row in the key from 1, by (t_ms, protocol), and the key's number of rows."""
    df = df.withColumn("_slice", slice_of())
    sizes = df.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total))
    inner = df.withColumn("_inner", F.row_number().over(ordered(key)))
    return inner.join(sizes, [*key, "_slice"]).withColumn(name, F.col("_inner") + F.col("_before")).drop("_slice", "_inner", "_before")


def with_neighbours(df: DataFrame, value: str, key: list[str], slice_: Column, order: list[str], back: str | None = "before", on: str | None = "after") -> DataFrame:
    """df with the last non-null value at or before each row (back) and the first at or after it (on), in the order within the key.

    slice_ cuts the key's rows into consecutive parts; what lies beyond a part comes from a table of one row a part.
    """
    df = df.withColumn("_part", slice_)
    inner = Window.partitionBy(*key, "_part").orderBy(*order)
    ends = df.groupBy(*key, "_part").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"), F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_first"))
    # What comes is read in the order turned round, so that the frame grows: one that shrinks is gone through anew for each row.
    before = lambda *o: Window.partitionBy(*key).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *key, "_part", F.last("_last", ignorenulls=True).over(before("_part")).alias("_carried"), F.last("_first", ignorenulls=True).over(before(F.desc("_part"))).alias("_coming"))
    out = df
    if back:
        out = out.withColumn("_b", F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    if on:
        turned = Window.partitionBy(*key, "_part").orderBy(*[F.desc(c) for c in order])
        out = out.withColumn("_a", F.last(value, ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(carried, [*key, "_part"])
    if back:
        out = out.withColumn(back, F.coalesce("_b", "_carried"))
    if on:
        out = out.withColumn(on, F.coalesce("_a", "_coming"))
    return out.drop("_part", "_carried", "_coming", "_b", "_a")
