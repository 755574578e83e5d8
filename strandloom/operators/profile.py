"""Column profiles of large tables, from footers and dictionaries where those suffice and from a scan elsewhere.

Every row group of every file is first asked what its footer and its dictionaries can tell, on the executors.  A column chunk
whose row group belongs to one load and whose statistics settle every asked question is done with; the other chunks, and no
more of their row groups than those chunks and the numbers of their loads, are read and counted where they lie.  What moves
is counts per (load, column, value), so that a load that holds a third of all rows is spread over all tasks; everything else is
a sum over those counts.

Defined cases: NaN is not null; NaN and infinite values are no finite values; -0.0 is 0.0.  A column without finite values in
range has no median and no shift; one without finite values is not short of distinct ones.  Rows with a null load are a load
of their own in ``profile`` and left out of ``issues`` (a result row names its load).  An empty table has no loads.  A table
that is not a plain read of Parquet files is scanned by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut, ship

FACTS = "load_id int, name string, value double, n bigint"
#: Shares of departures: how far the share of nulls may exceed the accepted one; finite values to a distinct one.
NULL_MARGIN, PER_DISTINCT = 0.2, 10


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def _settled(f: dict, n_rows: int, bounds: tuple[float, ...] | None) -> list[tuple[float | None, int]] | None:
    """(value, n) of a chunk of one load by its statistics, or None where they do not settle what is asked.

    Without bounds every count must be that of its value: all values are null, or a dictionary of one value covers the
    chunk.  With the accepted range and quartiles, all finite values may also lie on one side of (or all within) the
    quartiles: any split of the counts among them gives the same answers then.
    """
    nulls, values = f["nulls"], f["values"]
    if nulls is None:
        return None
    if nulls == n_rows:
        return [(None, nulls)]
    if values is None or not len(values):
        return None
    v = [float(x) for x in values]
    if len(v) > 1:
        if bounds is None:
            return None
        low, high, q25, q75 = bounds
        if not all(math.isfinite(x) and low <= x <= high for x in v) or len({"<" if x < q25 else ">" if x > q75 else "=" for x in v}) > 1:
            return None
    return [(None, nulls), (v[0], n_rows - nulls - len(v) + 1), *((x, 1) for x in v[1:])]


def _flat(table):
    """A table of plain columns, those of structs named by their path."""
    while any(str(t).startswith("struct") for t in table.schema.types):
        table = table.flatten()
    return table


def _counted(table, load: str, columns: dict[str, str]) -> Iterator:
    """(load_id, name, value, n) of a part of a file, a batch a column."""
    import numpy as np
    import pyarrow as pa

    of = table.column(load).combine_chunks()
    no_load = of.is_null().to_numpy(zero_copy_only=False)
    loads = of.fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    for name, column in columns.items():
        c = table.column(column).combine_chunks().cast(pa.float64())
        null = c.is_null().to_numpy(zero_copy_only=False)
        v = c.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
        v[np.isnan(v)] = np.nan  # one NaN
        order = np.lexsort((v.view("i8"), null, loads, no_load))
        keys = [x[order] for x in (v.view("i8"), null, loads, no_load)]
        first = np.ones(len(order), bool)
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.flatnonzero(first)
        yield _batch(keys[2][at], keys[3][at], [name] * len(at), v[order][at], keys[1][at], np.diff(np.append(at, len(order))), True)


def _batch(loads, no_load, names, values, null, n, scanned: bool):
    import pyarrow as pa

    arrays = [pa.array(loads, pa.int32(), mask=no_load), pa.array(names, pa.string()), pa.array(values, pa.float64(), mask=null), pa.array(n, pa.int64()), pa.array([scanned] * len(names), pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["load_id", "name", "value", "n", "scanned"])


def chunk_counts(df: DataFrame, columns: dict[str, str], load: str, bounds: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(load_id, name, value, n, scanned) of a plain read of Parquet files, row group by row group: ``scanned`` tells the counts
    that come from a chunk that was read from those that its statistics gave.

    The first step reads footers and dictionaries and leaves one row a row group on shared storage; the driver gets the
    names of the files of which nothing is settled, out of the list of files that it has."""
    spark, paths = df.sparkSession, df.inputFiles()
    ship(spark)
    fact = "struct<load_id:int,name:string,value:double,n:bigint>"

    def footers(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        from strandloom.sources.footers import chunk_facts, open_file

        facts_type = pa.list_(pa.struct([("load_id", pa.int32()), ("name", pa.string()), ("value", pa.float64()), ("n", pa.int64())]))
        schema = pa.schema([("path", pa.string()), ("grp", pa.int32()), ("facts", facts_type), ("left_over", pa.list_(pa.string())), ("whole", pa.bool_())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_file(path) as source:
                    meta = pq.read_metadata(source)
                    index = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        n_rows, facts, left = meta.row_group(g).num_rows, [], []
                        of = chunk_facts(source, meta, g, index[load], dictionaries=False) if load in index else {"nulls": None, "low": None, "high": None}
                        one = of["nulls"] == 0 and of["low"] is not None and of["low"] == of["high"]
                        for name, column in columns.items():
                            got = _settled(chunk_facts(source, meta, g, index[column]), n_rows, bounds and bounds[name]) if one and column in index else None
                            if got is None:
                                left.append(name)
                            else:
                                facts += [{"load_id": int(of["low"]), "name": name, "value": v, "n": int(n)} for v, n in got if n]
                        rows.append({"path": path, "grp": g, "facts": facts, "left_over": left})
                whole = all(len(r["left_over"]) == len(columns) for r in rows)
                yield pa.RecordBatch.from_pylist([r | {"whole": whole} for r in rows], schema=schema)

    def chunks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        from strandloom.sources.footers import open_file

        for batch in batches:
            for row in batch.to_pylist():
                if facts := row["facts"]:
                    null = np.array([f["value"] is None for f in facts])
                    yield _batch(np.array([f["load_id"] for f in facts]), np.zeros(len(facts), bool), [f["name"] for f in facts], np.array([f["value"] or 0.0 for f in facts]) + 0.0, null, [f["n"] for f in facts], False)
                if not row["left_over"]:
                    continue
                wanted = {n: columns[n] for n in row["left_over"]}
                with open_file(row["path"]) as source:
                    file = pq.ParquetFile(source)
                    here = {file.metadata.schema.column(i).path for i in range(file.metadata.num_columns)}
                    table = _flat(file.read_row_group(row["grp"], columns=sorted({load, *wanted.values()} & here)))
                    for c in {load, *wanted.values()} - here:  # a file that lacks a column has nulls in it
                        table = table.append_column(c, pa.nulls(file.metadata.row_group(row["grp"]).num_rows, pa.float64()))
                if table.num_rows:
                    yield from _counted(table, load, wanted)

    cores = spark.sparkContext.defaultParallelism
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * cores)))
    groups = cut(files.mapInArrow(footers, f"path string, grp int, facts array<{fact}>, left_over array<string>, whole boolean"))
    whole = {r.path for r in groups.where("whole").select("path").distinct().toLocalIterator()}
    parts = []
    if whole:
        scan = df if len(whole) == len(paths) else spark.read.schema(df.schema).parquet(*sorted(whole))
        parts.append(_scanned(scan, columns, load).withColumn("scanned", F.lit(True)))
    if len(whole) < len(paths):
        # a row group is a unit of work of its own, whatever file it lies in
        rest = groups.where("not whole").drop("whole").repartition(max(1, min(8 * len(paths), 4 * cores)), "path", "grp")
        parts.append(rest.mapInArrow(chunks, f"{FACTS}, scanned boolean"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _scanned(df: DataFrame, columns: dict[str, str], load: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in columns.items()])).alias("x")
    return df.select(F.col(load).alias("load_id"), each).groupBy("load_id", "x.name", "x.value").agg(F.count(F.lit(1)).alias("n")).select("load_id", "name", "value", "n")


def _is_plain_read(df: DataFrame) -> bool:
    """Whether a table is all of some Parquet files and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().split("\n")[0].lower()


def value_counts(df: DataFrame, columns: dict[str, str], load: str, bounds: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(load_id, name, value, n) of the named columns: from statistics for chunks they settle, read for the rest.

    With bounds, counts of settled chunks stand for the questions of ``issues`` and need not be those of single values."""
    if not _is_plain_read(df) or not df.inputFiles():
        return _scanned(df, columns, load)
    return chunk_counts(df, columns, load, bounds).groupBy("load_id", "name", "value").agg(F.sum("n").alias("n"))


def issues(df: DataFrame, accepted: DataFrame, columns: dict[str, str], load: str = "load_id") -> DataFrame:
    """(load_id, column_name, issue) of loads that depart from the accepted profile; ``accepted`` has one row per column
    (column_name, min_value, max_value, null_share, q25, q75) and is as small as the list of columns."""
    spec = {r.column_name: r for r in accepted.where(F.col("column_name").isin(*columns)).collect()}
    columns = {n: c for n, c in columns.items() if n in spec}
    if not columns:
        return df.sparkSession.createDataFrame([], "load_id int, column_name string, issue string")
    bounds = {n: (s.min_value, s.max_value, s.q25, s.q75) for n, s in spec.items()}
    counts = value_counts(df, columns, load, bounds).where("load_id is not null")

    def of(field: str) -> Column:
        return F.element_at(F.create_map(*[x for n, s in spec.items() for x in (F.lit(n), F.lit(float(s[field])))]), F.col("name"))

    counts = counts.withColumns({k: of(k) for k in ("min_value", "max_value", "q25", "q75")})
    v, n = F.col("value"), F.col("n")
    ok = _finite(v)
    inside = ok & v.between(F.col("min_value"), F.col("max_value"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    per = counts.groupBy("load_id", "name").agg(
        F.sum(n).alias("rows"),
        total(v.isNull()).alias("nulls"),
        total(v.isNotNull() & ~ok).alias("odd"),
        total(ok).alias("finite"),
        F.count(F.when(ok, 1)).alias("distinct"),
        total(ok & ~inside).alias("outside"),
        total(inside).alias("inside"),
        total(inside & (v < F.col("q25"))).alias("below"),
        F.max(F.when(inside & (v < F.col("q25")), v)).alias("below_max"),
        F.min(F.when(inside & (v >= F.col("q25")), v)).alias("from_q25"),
        total(inside & (v > F.col("q75"))).alias("above"),
        F.min(F.when(inside & (v > F.col("q75")), v)).alias("above_min"),
        F.max(F.when(inside & (v <= F.col("q75")), v)).alias("to_q75"),
    )
    # The median against a bound from counts alone: it is below q25 where more than half of the values are; where exactly
    # half are, it is the mean of the two values next to the bound.
    low = (2 * F.col("below") > F.col("inside")) | ((2 * F.col("below") == F.col("inside")) & ((F.col("below_max") + F.col("from_q25")) / 2 < of("q25")))
    high = (2 * F.col("above") > F.col("inside")) | ((2 * F.col("above") == F.col("inside")) & ((F.col("above_min") + F.col("to_q75")) / 2 > of("q75")))
    found = F.array_compact(
        F.array(
            F.when(F.col("nulls") / F.col("rows") > of("null_share") + NULL_MARGIN, "null_rate"),
            F.when(F.col("odd") > 0, "not_finite"),
            F.when(F.col("outside") > 0, "range"),
            F.when(F.col("distinct") * PER_DISTINCT < F.col("finite"), "distinct"),
            F.when((F.col("inside") > 0) & (low | high), "shift"),
        )
    )
    return per.select(F.col("load_id").cast("int").alias("load_id"), F.col("name").alias("column_name"), F.explode(found).alias("issue"))


def profile(df: DataFrame, columns: dict[str, str], load: str = "load_id", accepted: DataFrame | None = None) -> DataFrame:
    """One row per load and column: n_rows, n_null, n_nan, n_infinite, n_outside (finite values out of the accepted range),
    n_distinct (finite values), min_finite, q25, median, q75, max_finite (exact, of the finite values; quantiles between two
    values are interpolated).

    ``accepted`` is that of ``issues``; n_outside is null for columns, or bounds, that it does not give."""
    counts = value_counts(df, columns, load)
    v, n = F.col("value"), F.col("n")
    ok = _finite(v)
    bounds = {r.column_name: r for r in accepted.where(F.col("column_name").isin(*columns)).collect()} if accepted is not None else {}

    def of(field: str) -> Column:
        given = [x for name, r in bounds.items() for x in (F.lit(name), F.lit(r[field]).cast("double"))]
        return F.element_at(F.create_map(*given), F.col("name")) if given else F.lit(None).cast("double")

    low, high = of("min_value"), of("max_value")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    per = counts.groupBy("load_id", "name").agg(
        F.sum(n).cast("bigint").alias("n_rows"),
        total(v.isNull()).alias("n_null"),
        total(F.isnan(v)).alias("n_nan"),
        total(v.isNotNull() & ~F.isnan(v) & ~ok).alias("n_infinite"),
        F.when(F.max(low.isNotNull() & high.isNotNull()), total(ok & ~v.between(low, high))).alias("n_outside"),
        F.count(F.when(ok, 1)).alias("n_distinct"),
        F.min(F.when(ok, v)).alias("min_finite"),
        F.max(F.when(ok, v)).alias("max_finite"),
    )
    quantiles = _quantiles(counts.where(ok), {"q25": 0.25, "median": 0.5, "q75": 0.75}).withColumnsRenamed({"load_id": "_load", "name": "_name"})
    on = per["load_id"].eqNullSafe(F.col("_load")) & (per["name"] == F.col("_name"))
    return per.join(quantiles, on, "left").select(
        "load_id", F.col("name").alias("column_name"), "n_rows", "n_null", "n_nan", "n_infinite", "n_outside", "n_distinct", "min_finite", "q25", "median", "q75", "max_finite"
    )


def _quantiles(counts: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles of finite values per (load_id, name), between two values interpolated.

    Values fall into logarithmic buckets of 2 % width; running sums over those find the buckets in which the wanted places
    lie, and only values of these buckets are put in order, so that no task orders all values of a load."""
    v = F.col("value")
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.ceil(F.log(F.abs(v)) / math.log(1.02)) + 100_000)).cast("int")
    counts = counts.withColumn("b", bucket)
    by = ["load_id", "name"]
    of = Window.partitionBy(*by)
    hist = counts.groupBy(*by, "b").agg(F.sum("n").alias("m"))
    hist = hist.withColumns({"before": F.sum("m").over(of.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m"), "all_of": F.sum("m").over(of)})
    place = {name: F.lit(q) * (F.col("all_of") - 1) for name, q in qs.items()}
    holds = F.lit(False)
    for p in place.values():
        for at in (F.floor(p), F.ceil(p)):
            holds = holds | ((at >= F.col("before")) & (at < F.col("before") + F.col("m")))
    wanted = hist.where(holds).select(F.col("load_id").alias("_l"), F.col("name").alias("_n"), F.col("b").alias("_b"), "before", "all_of")
    rows = counts.join(wanted, counts["load_id"].eqNullSafe(F.col("_l")) & (counts["name"] == F.col("_n")) & (counts["b"] == F.col("_b")))
    within = Window.partitionBy(*by, "b").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("up_to", F.col("before") + F.sum("n").over(within))

    def quantile(p: Column) -> Column:
        a, b = (F.min(F.when(F.col("up_to") > at, v)) for at in (F.floor(p), F.ceil(p)))
        return a + (b - a) * F.max(p - F.floor(p))

    return rows.groupBy(*by).agg(*[quantile(p).alias(name) for name, p in place.items()])


def changes(profiled: DataFrame) -> DataFrame:
    """(load_id, column_name, previous_load, null_share_change, median_change, spread_change, distinct_share_change): each load
    against the one before it by number, from rows of ``profile``; a load without values has null for what it lacks.  One row a
    load and column: the window is as small as that."""
    finite = F.col("n_rows") - F.col("n_null") - F.col("n_nan") - F.col("n_infinite")
    facts = profiled.where("load_id is not null").select(
        "load_id", "column_name", (F.col("n_null") / F.col("n_rows")).alias("null_share"), "median", (F.col("q75") - F.col("q25")).alias("spread"), F.when(finite > 0, F.col("n_distinct") / finite).alias("distinct_share")
    )
    before = Window.partitionBy("column_name").orderBy("load_id")
    names = ("null_share", "median", "spread", "distinct_share")
    return facts.select("load_id", "column_name", F.lag("load_id").over(before).alias("previous_load"), *[(F.col(n) - F.lag(n).over(before)).alias(f"{n}_change") for n in names]).where("previous_load is not null")


def pattern_violations(df: DataFrame, patterns: dict[str, tuple[str, str]], load: str = "load_id") -> DataFrame:
    """(load_id, column_name, n_values, n_violations) per load: values of text columns that are not matched as a whole by their
    pattern; patterns is name -> (column, pattern).  Null is no value; a null load is a load of its own."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).isNotNull().alias("is_value"), F.coalesce(~F.col(c).rlike(rf"\A(?:{p})\z"), F.lit(False)).alias("bad")) for n, (c, p) in patterns.items()])
    rows = df.select(F.col(load).alias("load_id"), F.explode(parts).alias("x"))
    return rows.groupBy("load_id", F.col("x.name").alias("column_name")).agg(F.count(F.when(F.col("x.is_value"), 1)).alias("n_values"), F.count(F.when(F.col("x.bad"), 1)).alias("n_violations"))


def footer_profile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per column of the whole table: n_rows, n_null, low, high and n_distinct (NaN and infinite values count as
    values, NaN not as an extreme), from footers and dictionaries; only row groups without a covering dictionary or
    statistics are read, one row group and column at a time."""
    spark = df.sparkSession

    def facts(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow.parquet as pq

        from strandloom.sources.footers import chunk_facts, open_file

        for batch in batches:
            for path in batch["path"]:
                with open_file(path) as source:
                    file = pq.ParquetFile(source)
                    meta = file.metadata
                    index = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        for name, column in columns.items():
                            if column not in index:
                                continue
                            n = meta.row_group(g).num_rows
                            f = chunk_facts(source, meta, g, index[column])
                            values, nulls = f["values"], f["nulls"]
                            if values is None or nulls is None:
                                read = file.read_row_group(g, columns=[column]).flatten()
                                while any(str(t).startswith("struct") for t in read.schema.types):
                                    read = read.flatten()
                                col = read.column(column).combine_chunks()
                                values, nulls = np.asarray(col.drop_null().to_numpy(zero_copy_only=False), "f8"), col.null_count
                            values = np.unique(values.astype("f8"))
                            is_value = np.arange(len(values) + 1) > 0
                            counts = {"n_rows": np.where(is_value, 0, n), "n_null": np.where(is_value, 0, nulls)}
                            yield pd.DataFrame({"name": name, "value": np.concatenate([[0.0], values])} | counts | {"is_value": is_value})

    paths = df.inputFiles()
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    told = files.mapInPandas(facts, "name string, value double, n_rows bigint, n_null bigint, is_value boolean")
    v = F.when(F.col("is_value"), F.coalesce(F.col("value"), F.lit(float("nan"))))
    per = told.groupBy("name", v.alias("v")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"))
    plain = F.when(~F.isnan("v"), F.col("v"))
    return per.groupBy(F.col("name").alias("column_name")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.count("v").alias("n_distinct"), F.min(plain).alias("low"), F.max(plain).alias("high")
    )
