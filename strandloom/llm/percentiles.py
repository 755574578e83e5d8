"""Percentiles with bounded relative error from signed logarithmic buckets.

A value v != 0 falls into bucket ceil(ln|v| / ln g) of its sign, with g = (1 + a) / (1 - a); every value of a bucket is
within the relative error a of the bucket's representative 2 g^i / (g + 1).  A sketch is a table of (group, sign, bucket,
count); sketches of other partitions, loads or days are combined by adding counts, and the answers are those of one sketch
over everything.  No bucket is ever collapsed, so the bound holds for every percentile.

The number of buckets grows with the logarithm of the range of values (about 115 a decade at a = 0.01), not with the rows; counting is map-side first, so a group with a third of all rows is no hot task.

Defined cases: null, NaN and infinite values are no values; +0.0, -0.0 are the value 0 with an exact bucket of its own;
a group without values has no row.  A percentile q is the value at rank floor(q (n - 1)) of the ascending values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relative error of every percentile.
ACCURACY = 0.01


def _gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(v: Column, accuracy: float = ACCURACY) -> Column:
    """Bucket within its sign; 0 for the value zero (whose sign is 0)."""
    return F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(accuracy)))).cast("int"))


def sketch(values: DataFrame, keys: list[str], value: str = "value", accuracy: float = ACCURACY) -> DataFrame:
    """(keys..., sign, bucket, n)."""
    v = F.col(value).cast("double")
    real = values.where(v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf")))
    return real.groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket(v, accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def combine(*sketches: DataFrame) -> DataFrame:
    """The sketch of everything the given ones have seen."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def percentiles(sketched: DataFrame, keys: list[str], qs: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys..., n, one column per percentile).  The window runs over the buckets of a group, of which there are few."""
    g = _gamma(accuracy)
    place = F.col("sign") * F.col("bucket")
    order = Window.partitionBy(*keys).orderBy("sign", place)
    up_to = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_of = F.sum("n").over(Window.partitionBy(*keys))
    estimate = F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    run = sketched.select(*keys, "n", up_to.alias("up_to"), all_of.alias("all_of"), estimate.alias("estimate"))
    picks = []
    for name, q in qs.items():
        rank = F.floor(F.lit(q) * (F.col("all_of") - 1))
        picks.append(F.max(F.when((rank < F.col("up_to")) & (rank >= F.col("up_to") - F.col("n")), F.col("estimate"))).alias(name))
    return run.groupBy(*keys).agg(F.max("all_of").alias("n"), *picks)


def measured_error(values: DataFrame, keys: list[str], qs: dict[str, float], value: str = "value", accuracy: float = ACCURACY) -> DataFrame:
    """(keys..., percentile, n, exact, estimate, relative_error): the percentiles of the sketch beside the exact ones.

    The sketch tells the bucket that holds each percentile; only values of these buckets are counted one by one and put in
    order, so that no group is sorted whole.  relative_error is 0 where both are 0."""
    sketched = sketch(values, keys, value, accuracy)
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    run = sketched.withColumns({"before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"), "all_of": F.sum("n").over(Window.partitionBy(*keys))})
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("percentile"), F.lit(q).alias("q")) for k, q in qs.items()])).alias("p")
    run = run.select(*keys, "sign", "bucket", "before", "n", "all_of", asked).select("*", "p.*").withColumn("rank", F.floor(F.col("q") * (F.col("all_of") - 1)))
    held = run.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n", "p")
    v = F.col(value).cast("double")
    real = values.where(v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf")))
    one = real.groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket(v, accuracy).alias("bucket"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = held.join(one, [*keys, "sign", "bucket"])
    within = Window.partitionBy(*keys, "percentile").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("up_to", F.col("before") + F.sum("n").over(within))
    g = _gamma(accuracy)
    estimate = F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    got = rows.where((F.col("up_to") > F.col("rank")) & (F.col("up_to") - F.col("n") <= F.col("rank"))).select(*keys, "percentile", F.col("all_of").alias("n"), F.col("v").alias("exact"), estimate.alias("estimate"))
    return got.withColumn("relative_error", F.when(F.col("exact") == 0, F.abs("estimate")).otherwise(F.abs(F.col("estimate") - F.col("exact")) / F.abs("exact")))
