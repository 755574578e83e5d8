"""Counting of values and grouping of variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a completed table at most.
MOST_CELLS = 1_000_000


def value_counts(entries: DataFrame, dims: dict[str, Column], per_variant: str | None = None, complete: bool = False) -> DataFrame:
    """(dims..., n): null is a value.  per_variant names the identifier within which a tuple counts once; complete fills in
    combinations that do not occur (the values of each dimension are few; checked against MOST_CELLS)."""
    cols = [c.alias(n) for n, c in dims.items()]
    rows = entries.select(per_variant, *cols).distinct() if per_variant else entries.select(*cols)
    got = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    if not complete:
        return got
    axes = [got.select(d).distinct() for d in dims]
    cells = 1
    for a in axes:
        cells *= max(1, a.count())
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} cells")
    grid = axes[0]
    for a in axes[1:]:
        grid = grid.join(a)  # of a checked size
    cells_with = got.select(*[F.col(d).alias(f"_{d}") for d in dims], "n")
    on = F.lit(True)
    for d in dims:
        on = on & F.col(d).eqNullSafe(F.col(f"_{d}"))
    return grid.join(cells_with, on, "left").select(*dims, F.coalesce("n", F.lit(0)).alias("n"))


def value_counts_by(entries: DataFrame, fn: Callable[..., Column], args: list[str]) -> DataFrame:
    """Counts of what a function makes of columns: Column in, Column out, so that it stays in the plan."""
    return value_counts(entries, {"value": fn(*[F.col(a) for a in args])})


def value_counts_blocks(entries: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Counts by a function that turns a pandas block into an additive table of counts with a column n."""
    keys = [f.strip().split()[0] for f in schema.split(",") if f.strip().split()[0] != "n"]

    def run(blocks):
        for b in blocks:
            out = fn(b)
            if out is not None:
                yield out

    return entries.mapInPandas(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


Condition = list | tuple | Callable[[Column], Column] | None


def per_record(df: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """Entries for counting fields of one value per variant against fields of several: a row per member of the lists, which
    are of one length, with the scalars beside each; a variant whose lists are null or empty has no row.  Names are columns or
    paths; dots become underscores."""
    flat = lambda n: n.replace("/", "_").replace(".", "_")
    path = lambda n: F.col(n.replace("/", "."))
    zipped = F.explode(F.arrays_zip(*[path(n).alias(flat(n)) for n in lists])).alias("_x")
    return df.select(*[path(n).alias(flat(n)) for n in scalars], zipped).select(*[flat(n) for n in scalars], "_x.*")


#: Identifiers of a container.
CONTAINER = 1 << 16


def _named(entries: DataFrame, names: list[str]) -> DataFrame:
    """Entries with a column for each name that is a path to a leaf (``info/variant_type``)."""
    from strandloom.operators.catalog import leaves

    known = dict(leaves(entries))
    for n in names:
        if n not in entries.columns:
            if n not in known and n.replace("/", ".") not in known.values():
                raise ValueError(f"no such field: {n}")
            entries = entries.withColumn(n, F.col(known.get(n, n.replace("/", "."))))
    return entries


def unit_members(entries: DataFrame, by: list[str], cond: dict[str, Condition] | None = None, positions: tuple[str, str] = ("chr", "position")) -> DataFrame:
    """(keys..., container, index, first, last): the variants of each key in containers of CONTAINER neighbouring indices, each
    once and sorted, with (chr, position) of the lowest and the highest.

    cond: per field a list of accepted values, a function Column -> Column (a predicate, or for a key a new key), or None
    for no condition.  A condition that is null keeps the entry; null and empty keys are dropped.  Fields are columns or paths
    to leaves (``info/variant_type``).  However many variants a key has, no row and no task holds more of them than a
    container: repeated ones go on the map side.
    """
    cond = cond or {}
    entries = _named(entries, [*by, *cond])
    keep = F.lit(True)
    for name, c in cond.items():
        if name in by or c is None:
            continue
        keep = keep & (F.coalesce(F.col(name).isin(list(c)), F.lit(False)) if isinstance(c, (list, tuple)) else c(F.col(name)))
    keys = [(cond[k](F.col(k)) if callable(cond.get(k)) else F.when(F.col(k).isin(list(cond[k])), F.col(k)) if cond.get(k) else F.col(k)).alias(k) for k in by]
    rows = entries.where(F.coalesce(keep, F.lit(True)) & F.col("variant_idx").isNotNull()).select(*keys, F.col("variant_idx").cast("bigint").alias("variant_idx"), *positions)
    for k in by:
        rows = rows.where(F.col(f"`{k}`").isNotNull() & (F.col(f"`{k}`").cast("string") != ""))
    c, p = positions
    place = F.struct("variant_idx", F.col(c).alias("chr"), F.col(p).alias("position"))
    container = F.floor(F.col("variant_idx") / CONTAINER).alias("container")
    return rows.groupBy(*[F.col(f"`{k}`") for k in by], container).agg(F.sort_array(F.collect_set("variant_idx")).alias("index"), F.min(place).alias("first"), F.max(place).alias("last"))


def unit_ranges(members: DataFrame, by: list[str]) -> DataFrame:
    """(keys..., n, chr, start, end) of what ``unit_members`` gives: everything about a unit but its indices."""
    return members.groupBy(*by).agg(F.sum(F.size("index")).alias("n"), F.min("first").alias("a"), F.max("last").alias("b")).select(*by, "n", F.col("a.chr").alias("chr"), F.col("a.position").alias("start"), F.col("b.position").alias("end"))


def unit_groups(entries: DataFrame, by: list[str], cond: dict[str, Condition] | None = None, positions: tuple[str, str] = ("chr", "position"), ordered: bool = False) -> DataFrame:
    """(keys..., chr, start, end, index): variant indices by key, sorted and once each, with place of the first and the last.

    Conditions as in ``unit_members``, whose containers are joined here to one row a key; for keys that hold more variants than
    a row can, take those.  ordered: by the first index of each key.
    """
    members = unit_members(entries, by, cond, positions)
    parts = F.sort_array(F.collect_list(F.struct("container", "index")))
    cols = [F.col(f"`{k}`") for k in by]
    out = members.groupBy(*cols).agg(F.min("first").alias("a"), F.max("last").alias("b"), F.flatten(F.transform(parts, lambda x: x["index"])).alias("index"))
    out = out.select(*cols, F.col("a.chr").alias("chr"), F.col("a.position").alias("start"), F.col("b.position").alias("end"), "index")
    return out.orderBy(F.col("index")[0], *cols) if ordered else out
