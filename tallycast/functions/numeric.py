"""Rounding and distributed order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.running import running_sums


#: From here on a double has no digits after the point.
WHOLE = float(1 << 53)


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up. The small surplus sends ties, which float noise moves either way, always up. NaN, infinities
    and numbers too large for a fraction stay as they are."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.when(F.abs(c * scale) < WHOLE, F.floor(c * scale + 0.500001) / scale).otherwise(c.cast("double"))


def half_up_sql(expr: str, digits: int) -> str:
    """The same as SQL text, for wide projections."""
    scale = f"1{'0' * digits}D"
    return f"CASE WHEN abs(({expr}) * {scale}) < {WHOLE:.0f}D THEN floor(({expr}) * {scale} + 0.500001D) / {scale} ELSE CAST({expr} AS DOUBLE) END"


def value_levels(c: Column) -> list[Column]:
    """Two coarse functions that never decrease as `c` grows: 64, then 65,536 steps per power of two."""
    size = F.signum(c) * F.log2(1 + F.abs(c))
    return [F.floor(size * 64), F.floor(size * 65536)]


def exact_percentiles(df: DataFrame, keys: list[str], col: str, probs: list[float]) -> DataFrame:
    """Linear-interpolation percentiles as rows (keys, prob, value), without one task per group.

    Equal values are counted first, which is where the volume shrinks; ranks then come from
    running counts over coarse levels of the value.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = value_levels(F.col("v"))
    counts = counts.withColumn("lvl_a", lo).withColumn("lvl_b", hi)
    ranked = running_sums(counts, keys, ["lvl_a", "lvl_b"], ["v"], {"upto": F.col("n")}, totals=True)
    marks = ranked.select(
        *keys, "v", "n", "upto", "tot_upto",
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
    ).withColumn("pos", F.col("prob") * (F.col("tot_upto") - 1))
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    below, above = F.floor("pos"), F.ceil("pos")
    return (
        marks.groupBy(*keys, "prob")
        .agg(
            F.max(F.when((first <= below) & (below <= last), F.col("v"))).alias("v_lo"),
            F.max(F.when((first <= above) & (above <= last), F.col("v"))).alias("v_hi"),
            F.max(F.col("pos") - below).alias("frac"),
        )
        .select(*keys, "prob", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value"))
    )
