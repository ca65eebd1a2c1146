"""Ordered computations over groups of any size.

A window partitioned by a key alone puts a whole group into one task. Here every row also
carries a *segment*: a coarse value which grows with the sort order (a month, a price
band, a block of ids). Rows are windowed per (key, segment), segments are summarised with a
map-side combine, and the few summaries carry the running state from one segment to the
next. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def cut_points(df: DataFrame, order: list[str], segments: int = 64, sample: int = 6400) -> Column:
    """Sort keys that part the rows into about even segments: an array of structs of ``order``.

    They come from a random sample of bounded size. A row's segment is the number of cuts at or
    before its key; which cuts were drawn changes the sizes of the segments, never a result.
    """
    place = df.select(F.struct(*order).alias("place"))
    drawn = place.orderBy(F.rand(11)).limit(sample).agg(F.array_sort(F.collect_list("place")).alias("all")).first()["all"]
    kind = place.schema["place"].dataType
    chosen = sorted({i * len(drawn) // segments for i in range(1, segments)}) if drawn else []
    literal = lambda row: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)])
    return F.array(*[literal(drawn[i]) for i in chosen]).cast(ArrayType(kind))


def ranked(
    df: DataFrame, keys: list[str], segment: str, order: list[Column], name: str = "rank", descending: bool = False
) -> DataFrame:
    """row_number() over (partition by keys order by segment, order)."""
    per_segment = df.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_rows"))
    direction = F.col(segment).desc() if descending else F.col(segment)
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_segment.select(*keys, segment, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, segment).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + [segment])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_local", "_before")
    )


def key_totals(df: DataFrame, keys: list[str], segment: str, values: dict[str, Column]) -> DataFrame:
    """Adds sum(value) over (partition by keys) to each row. Rows meet the totals by (keys, segment), so no task gets all rows of a key."""
    per_segment = df.groupBy(*keys, segment).agg(*[F.sum(value).alias(f"_t_{name}") for name, value in values.items()])
    whole = Window.partitionBy(*keys)
    totals = per_segment.select(*keys, segment, *[F.sum(f"_t_{name}").over(whole).alias(name) for name in values])
    return df.join(totals, keys + [segment])


def running_sums(
    df: DataFrame, keys: list[str], segment: str, order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """sum(value) over (partition by keys order by segment, order rows up to the current one),
    for several values in one pass."""
    valued = df.select("*", *[value.alias(f"_v_{name}") for name, value in values.items()])
    per_segment = valued.groupBy(*keys, segment).agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values])
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_segment.select(
        *keys, segment, *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in values]
    )
    local = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.select("*", *[F.sum(f"_v_{name}").over(local).alias(f"_l_{name}") for name in values])
    return summed.join(offsets, keys + [segment]).select(
        *df.columns, *[(F.col(f"_b_{name}") + F.col(f"_l_{name}")).alias(name) for name in values]
    )


def running_sum(
    df: DataFrame, keys: list[str], segment: str, order: list[Column], value: Column, name: str
) -> DataFrame:
    return running_sums(df, keys, segment, order, {name: value})


def running_max(df: DataFrame, keys: list[str], segment: str, order: list[str], value: Column, name: str) -> DataFrame:
    """max(value) over (partition by keys order by segment, order rows up to the current one), nulls passed over."""
    valued = df.withColumn("_value", value)
    per_segment = valued.groupBy(*keys, segment).agg(F.max("_value").alias("_most"))
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_segment.select(*keys, segment, F.max("_most").over(before).alias("_carried"))
    local = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = valued.withColumn("_local", F.max("_value").over(local)).join(carried, keys + [segment])
    # Up to here the segment's own maximum may still be none, and the carried one may be larger.
    return joined.withColumn(name, F.greatest("_local", "_carried")).drop("_value", "_local", "_carried")


def neighbour(
    df: DataFrame, keys: list[str], segment: str, order: list[str], value: str, name: str, step: int = -1
) -> DataFrame:
    """lag (step -1) or lead (step 1) of a non-null value over (partition by keys order by segment, order)."""
    place = F.struct(*order)
    edge = F.max_by(value, place) if step < 0 else F.min_by(value, place)
    per_segment = df.groupBy(*keys, segment).agg(edge.alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(segment)
    local = Window.partitionBy(*keys, segment).orderBy(*order)
    moved = F.lag if step < 0 else F.lead
    edges = per_segment.select(*keys, segment, moved("_edge").over(across).alias("_edge"))
    return (
        df.withColumn("_local", moved(value).over(local))
        .join(edges, keys + [segment])
        .withColumn(name, F.coalesce("_local", "_edge"))
        .drop("_local", "_edge")
    )


def latest_at(
    probes: DataFrame, steps: DataFrame, keys: list[str], segment: str, position: str, values: list[str]
) -> DataFrame:
    """As-of join: each probe takes the values of the last step at or before its position.

    Both sides carry ``segment`` (growing with ``position``). Probes of segments before the
    first step get nulls. A step's position is unique per key for a defined result.
    """
    packed = F.struct(*[F.col(v) for v in values])
    marked = steps.select(
        *keys, segment, position, F.lit(0).alias("_kind"), packed.alias("_step"), F.lit(None).cast("struct<_x:int>").alias("_probe")
    )
    carried = [c for c in probes.columns if c not in (*keys, segment, position)]
    asked = probes.select(
        *keys, segment, position, F.lit(1).alias("_kind"), F.lit(None).cast(marked.schema["_step"].dataType).alias("_step"),
        F.struct(F.lit(1).alias("_set"), *carried).alias("_probe"),
    )
    marked = marked.withColumn("_probe", F.lit(None).cast(asked.schema["_probe"].dataType))
    rows = marked.unionByName(asked)
    per_segment = rows.groupBy(*keys, segment).agg(
        F.max_by("_step", F.when(F.col("_step").isNotNull(), F.col(position))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_segment.select(*keys, segment, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    local = (
        Window.partitionBy(*keys, segment).orderBy(position, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_here", F.last("_step", ignorenulls=True).over(local))
        .filter(F.col("_kind") == 1)
        .join(carry, keys + [segment])
        .withColumn("_got", F.coalesce("_here", "_carry"))
        .select(
            *keys, segment, position, *[F.col("_probe")[c].alias(c) for c in carried],
            *[F.col("_got")[v].alias(v) for v in values],
        )
    )
