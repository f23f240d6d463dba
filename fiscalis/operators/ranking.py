"""Exact ranks, quantiles and numbering that never gather a group in one task.

A group (one region, or the whole table) may hold a large share of all rows, so
a plain window or `percentile` over it would sort or hash it in one task. Here
equal values are counted first (map-side combine), every value gets a slot - an
order-preserving function of the value alone - and only slots are ordered per
group: the slot table is small by construction, whatever the data. A slot of more than
`SLOT_ROWS` rows is cut further into `SUB_SLOTS`, again by the value alone, whose
running sums start from their slot's. The rows of one slot, or of one part of a crowded
one, are ordered in their own task.

Groups with a NULL key are left out. That is said on the counts themselves, so
that the two uses of the counts have one plan and Spark computes them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slots per doubling of the value. Amounts up to 1e14 take under 15,000 slots a
# sign, which bounds the per-group slot table.
SLOTS_PER_DOUBLING = 256
SLOT_ROWS = 100_000
SUB_SLOTS = 1 << 16  # parts of a crowded slot: 4e-8 of the value wide


def _height(value: Column) -> Column:
    return F.log2(F.lit(1.0) + F.abs(value) * 1000.0) * SLOTS_PER_DOUBLING


def slot(value: Column) -> Column:
    """Order-preserving, data-independent slot number of a value (never NULL)."""
    size = F.floor(_height(value)).cast("int")
    return F.coalesce(F.when(value < 0, -size).otherwise(size), F.lit(0))


def sub_slot(value: Column) -> Column:
    """Order-preserving part of its slot that a value stands in. Slot 0 holds both signs."""
    height = _height(value)
    part = F.floor((height - F.floor(height)) * SUB_SLOTS).cast("int")
    return F.coalesce(F.when(value < 0, -part).otherwise(part), F.lit(0))


def running_sums(rows: DataFrame, keys: list[str], value: str, measures: list[str], ties: list | None = None) -> DataFrame:
    """Rows with `_run_<m>`, the sum of each measure up to and with the row in the order of the value (and
    `ties`) within the group, and `_total_<m>`, the group's sum."""
    here = [*keys, "_slot"]
    rows = rows.withColumn("_slot", slot(F.col(value)))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy(*here).agg(F.count(F.lit(1)).alias("_size"), *[F.sum(m).alias(f"_s_{m}") for m in measures]).select(
        *here, "_size", *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(Window.partitionBy(*keys)).alias(f"_total_{m}") for m in measures])
    return _run(rows.join(slots, here), here, value, measures, ties)


def _run(placed: DataFrame, here: list[str], value: str, measures: list[str], ties: list | None = None) -> DataFrame:
    """Rows that know their slot's size and start (`_size`, `_before_<m>`), with `_run_<m>`."""
    crowded = F.col("_size") > SLOT_ROWS
    placed = placed.withColumn("_sub", F.when(crowded, sub_slot(F.col(value))).otherwise(F.lit(0)))
    part, earlier = [*here, "_sub"], Window.partitionBy(*here).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    skipped = placed.where(crowded).groupBy(*part).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures]).select(
        *part, *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_skipped_{m}") for m in measures])
    inside = Window.partitionBy(*part).orderBy(value, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.join(skipped, part, "left")
    return whole.withColumns({f"_run_{m}": F.col(f"_before_{m}") + F.coalesce(f"_skipped_{m}", F.lit(0)) + F.sum(m).over(inside) for m in measures}).drop(
        "_slot", "_sub", "_size", *[f"_{kind}_{m}" for kind in ("before", "skipped") for m in measures])


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): one row per distinct non-null value of a group."""
    return (
        _keyed(df.where(F.col(value).isNotNull()), keys)
        .groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def positions(counts: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Counts with `below`, the rows of the group with a smaller value, and `total`; `counts` holds one row per (keys, value)."""
    placed = running_sums(_keyed(counts, keys), keys, "value", [weight])
    return placed.withColumn("below", F.col(f"_run_{weight}") - F.col(weight)).withColumnRenamed(f"_total_{weight}", "total").drop(f"_run_{weight}")


def mid_ranks(counts: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Counts with `rank`, the average rank of tied rows, and `total`."""
    return positions(counts, keys, weight).withColumn(
        "rank", F.col("below") + (F.col(weight) + 1) / 2.0)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, n, one column per quantile), linearly interpolated and exact.

    Only the slots that hold a wanted position are sorted.
    """
    counts = value_counts(df, keys, value).withColumn("_slot", slot(F.col("value")))
    here = [*keys, "_slot"]
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)

    def at(p: float) -> Column:
        return F.lit(float(p)) * (F.col("total") - 1)

    def held(index: Column, first: Column, size: Column) -> Column:
        return (index >= first) & (index < first + size)

    ends = [end(at(p)) for p in probs.values() for end in (F.floor, F.ceil)]
    wanted = None
    for index in ends:
        hit = held(index, F.col("_before_n"), F.col("_rows"))
        wanted = hit if wanted is None else wanted | hit
    slots = counts.groupBy(*here).agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_size")).select(
        *here, "_rows", "_size", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before_n"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("total")).where(wanted).drop("_rows")
    placed = _run(counts.join(slots, here), here, "value", ["n"]).withColumn("below", F.col("_run_n") - F.col("n"))

    def pick(index: Column) -> Column:
        return F.max(F.when(held(index, F.col("below"), F.col("n")), F.col("value")))

    picks = [F.max("total").alias("n_rows")]
    for name, p in probs.items():
        picks += [pick(F.floor(at(p))).alias(f"_{name}_lo"), pick(F.ceil(at(p))).alias(f"_{name}_hi")]
    found = placed.groupBy(*keys).agg(*picks) if keys else placed.agg(*picks)
    out = [F.col("n_rows").alias("n")]
    for name, p in probs.items():
        part = F.lit(float(p)) * (F.col("n_rows") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (part - F.floor(part))).alias(name))
    return found.select(*keys, *out)


def group_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5})


def numbered(df: DataFrame, coarse: dict[str, Column], order: list, name: str) -> DataFrame:
    """Add 1..n in the order (coarse keys, `order`) without a global sort.

    `coarse` names the leading order keys, never NULL; their distinct
    combinations are counted and offset, the rest is numbered per combination.
    """
    keys = list(coarse)
    first, rest = keys[0], keys[1:]
    df = df.withColumns(coarse)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # Prefix sums in two levels: over the few values of the first key, then inside each.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy(first).agg(F.sum("_rows").alias("_rows")).select(
        first, F.coalesce(F.sum("_rows").over(before.orderBy(first)), F.lit(0)).alias("_start"))
    within = F.sum("_rows").over(before.partitionBy(first).orderBy(*rest)) if rest else F.lit(0)
    offsets = sizes.select(*keys, F.coalesce(within, F.lit(0)).alias("_within")).join(starts, first).select(
        *keys, (F.col("_start") + F.col("_within")).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_before")
