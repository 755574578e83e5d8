"""Annotations for given variants: exact keys, first file wins, and ranges of positions.

Keys join on (chr, position, ref, alt); the multi-allelic list is compared whole.  The keys are looked at once: how many
bytes they are, and between which positions they lie on each chromosome.  Those bounds go to the scan of the source as a
filter on its own columns.  Keys of up to MOST_BYTES are sent to the source, which is reduced to the rows that are hit before
anything is sorted, grouped or moved; more keys than that meet the source, reduced to one row a key by a partial aggregate,
in a shuffle on the key.

Defined cases: a null or empty part of a key hits nothing; repeated keys give a row each; a key that several rows of the source
have takes the whole row of the lowest (file_idx, variant_idx); an empty source gives nulls, no keys give no rows.
"""

from __future__ import annotations

import logging
from functools import singledispatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.annotation import parse_key, plain_chr
from strandloom.session import cut, path_exists, rename

log = logging.getLogger(__name__)

KEY = ["chr", "position", "ref", "alt"]
#: Positions to a bin of the range join, and bins to a cell of ranges that are at least as long as one.
BIN, CELL = 16384, 64
#: Bytes of distinct keys that may be sent to every task of the source.
MOST_BYTES = 32 << 20
#: Chromosomes of the keys up to which each has position bounds of its own; beyond, all share one pair of bounds.
MOST_CHROMOSOMES = 100
SPECIAL = {":chromosome": "chr", ":position": "position", ":allele": "allele", ":id": "id", ":qual": "qual", ":filter": "filter"}


def resolve(source: DataFrame, fields: list[str] | dict[str, str] | None) -> list:
    """Columns for field names: the specials, ``info/..`` leaves by path, aliases where a dict names them."""
    from strandloom.operators.catalog import leaves

    if fields is None:
        fields = [n for n, _ in leaves(source)]
    pairs = fields.items() if isinstance(fields, dict) else [(None, f) for f in fields]
    out, known = [], dict(leaves(source))
    for alias, name in pairs:
        if name is None:
            raise ValueError("a field name is missing")
        if name in SPECIAL:
            out.append(F.col(SPECIAL[name]).alias(alias or SPECIAL[name]))
            continue
        path = known.get(name, name.replace("/", "."))
        if path.split(".")[0] not in source.columns:
            raise ValueError(f"no field {name}")
        out.append(F.col(path).alias(alias or path.split(".")[-1]))
    return out


def first_of_key(source: DataFrame, columns: list) -> DataFrame:
    """One row a key: the whole row of the lowest (file_idx, variant_idx)."""
    keyed = source.select(plain_chr(F.col("chr")).alias("chr"), "position", "ref", "alt", F.struct("file_idx", "variant_idx").alias("_at"), F.struct(*columns).alias("_v"))
    return keyed.groupBy(*KEY).agg(F.min_by("_v", "_at").alias("_v"), F.min("_at").alias("_at"))


def _look(keys: DataFrame) -> tuple[Column | None, Column | None, bool]:
    """(filter by chromosome, filter by chromosome and position, whether the keys may be sent to all tasks), from one aggregate
    over the keys."""
    size = F.sum(F.length("chr") + F.length("ref") + F.length("alt") + 40).alias("bytes")
    per = keys.where("chr is not null and position is not null").groupBy("chr").agg(F.min("position").alias("low"), F.max("position").alias("high"), size)
    rows = per.limit(MOST_CHROMOSOMES + 1).collect()
    if len(rows) > MOST_CHROMOSOMES:
        r = per.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("bytes").alias("bytes")).first()
        return None, F.col("position").between(r.low, r.high), r.bytes <= MOST_BYTES
    if not rows:
        return F.lit(False), F.lit(False), True
    names = lambda n: [n, f"chr{n}"]
    on_chr = F.col("chr").isin(*[x for r in rows for x in names(r.chr)])
    at = F.lit(False)
    for r in rows:
        at = at | (F.col("chr").isin(*names(r.chr)) & F.col("position").between(r.low, r.high))
    return on_chr, at, sum(r.bytes or 0 for r in rows) <= MOST_BYTES


def _hits(source: DataFrame, keys: DataFrame, at: Column | None, small: bool) -> DataFrame:
    """The rows of the source that may be hit by a key."""
    rows = source if at is None else source.where(at)
    if not small:
        return rows
    wanted = F.broadcast(keys.select(*[F.col(k).alias(f"_{k}") for k in KEY]).dropna().distinct())  # of a checked size
    on = (plain_chr(rows["chr"]) == wanted["_chr"]) & (rows["position"] == wanted["_position"]) & (rows["ref"] == wanted["_ref"]) & (rows["alt"] == wanted["_alt"])
    return rows.join(wanted, on, "left_semi")


def annotate_rows(keys: DataFrame, source: DataFrame, fields: list[str] | dict[str, str] | None) -> DataFrame:
    """Left join of keys (_row and KEY): exactly one row per key row, annotations null where there are none.

    fields=None: all leaves of info.  fields=[]: only variant_idx and file_idx; a miss has the last file of its chromosome
    that was tried.
    """
    keys = keys.select("_row", plain_chr(F.col("chr")).alias("chr"), "position", "ref", "alt")
    if keys._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LocalRelation":
        keys = cut(keys)  # they are read three times: for their bounds, to find hits, and to be joined
    on_chr, at, small = _look(keys)
    hits = _hits(source, keys, at, small)
    if fields is not None and not len(fields):
        found = keys.join(first_of_key(hits, [F.lit(1)]).select(*KEY, "_at.*"), KEY, "left")
        tried = source if on_chr is None else source.where(on_chr)
        last = tried.groupBy(plain_chr(F.col("chr")).alias("chr")).agg(F.max("file_idx").alias("_last"))
        return found.join(last, "chr", "left").select("_row", *KEY, "variant_idx", F.coalesce("file_idx", "_last").alias("file_idx"))
    found = first_of_key(hits, resolve(source, fields)).select(*KEY, "_v.*")
    return keys.join(found, KEY, "left").select("_row", *KEY, *[c for c in found.columns if c not in KEY])


@singledispatch
def annotate(variants, source: DataFrame, fields=None, **options) -> DataFrame:
    """Annotations for keys given as a list of strings or as a DataFrame (chr, pos, ref, alt), in input order."""
    raise TypeError(f"cannot annotate {type(variants).__name__}")


@annotate.register
def _(variants: list, source: DataFrame, fields=None, **options) -> DataFrame:
    spark: SparkSession = source.sparkSession
    rows = spark.createDataFrame(list(enumerate(variants)), "_row bigint, key string")
    return annotate_rows(rows.select("_row", parse_key(F.col("key")).alias("k")).select("_row", "k.*"), source, fields, **options).orderBy("_row")


@annotate.register
def _(variants: DataFrame, source: DataFrame, fields=None, col_chr="chr", col_pos="pos", col_ref="ref", col_alt="alt", row=None, ordered: bool = True, **options) -> DataFrame:
    """ordered: rows come in input order, for which the result is sorted by range; without, ``_row`` tells the order."""
    missing = {col_chr, col_pos, col_ref, col_alt} - set(variants.columns)
    if missing:
        raise ValueError(f"missing key columns: {sorted(missing)}")
    at = F.col(row) if row else F.monotonically_increasing_id()
    keys = variants.select(at.alias("_row"), F.col(col_chr).alias("chr"), F.col(col_pos).cast("int").alias("position"), F.col(col_ref).alias("ref"), F.col(col_alt).alias("alt"))
    got = annotate_rows(keys, source, fields, **options)
    return got.orderBy("_row") if ordered else got


@annotate.register
def _(variants: str, source: DataFrame, fields=None, **options) -> DataFrame:
    """The variants of a file: a variant call file by its ending (.vcf, .vcf.gz, .vcf.bgz), else a stored table."""
    return annotate(variants_of(source.sparkSession, variants).withColumnRenamed("position", "pos"), source, fields, row="variant_idx", **options)


def variants_of(spark: SparkSession, path: str) -> DataFrame:
    """(variant_idx, chr, position, ref, alt) of a variant call file or a stored table; samples and annotations are not read."""
    if path.rstrip("/").endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        from strandloom.sources import vcf

        df = vcf.read(spark, path, keep=[])
    else:
        df = spark.read.parquet(path)
    return df.select("variant_idx", *KEY)


def annotate_vcf(source: DataFrame, path: str, fields: list[str] | dict[str, str] | None = None, match: str = "range") -> DataFrame:
    """The source's annotations for the variants of a variant call file.  match="range": all rows of the source that lie on the
    reference bases of any of them, each once; match="allele": one row per variant, by its alleles, in order."""
    if match == "allele":
        return annotate(path, source, fields)
    if match != "range":
        raise ValueError(f"match is range or allele, not {match}")
    given = variants_of(source.sparkSession, path)
    r = given.select("chr", F.col("position").alias("start"), (F.col("position") + F.greatest(F.length("ref"), F.lit(1)) - 1).alias("end"))
    return annotate_ranges(source, r.withColumn("range_set", F.lit(0)), fields).drop("range_set")


def annotate_ranges(source: DataFrame, sets: list[DataFrame] | DataFrame, fields: list[str] | dict[str, str] | None = None) -> DataFrame:
    """(range_set, file_idx, variant_idx, chr, position, ref, alt, fields...): the rows of the source in each of several sets of
    closed ranges, once per set; file after file and place after place if sorted by the first three.

    sets: DataFrames (chr, start, end), or one DataFrame that has range_set too.
    """
    if isinstance(sets, DataFrame):
        one = sets.select("range_set", "chr", "start", "end")
    else:
        one = None
        for i, r in enumerate(sets):
            r = r.select(F.lit(i).alias("range_set"), "chr", "start", "end")
            one = r if one is None else one.unionByName(r)
        if one is None:
            one = source.sparkSession.createDataFrame([], "range_set int, chr string, start int, end int")
    fine, cells = _binned(one)
    values = [c.alias(f"_v{i}") for i, c in enumerate(resolve(source, fields))]
    names = source.select(*resolve(source, fields)).columns
    rows = source.select("file_idx", "variant_idx", *KEY, *values)
    cols = ["range_set", *rows.columns]
    got = rows.join(fine, _in_bin(rows, fine)).select(*cols)
    if cells is not None:
        got = got.unionByName(rows.join(cells, _in_cell(rows, cells)).select(*cols))
    got = got.dropDuplicates(["range_set", "file_idx", "variant_idx"])
    return got.select("range_set", "file_idx", "variant_idx", plain_chr(F.col("chr")).alias("chr"), *KEY[1:], *[F.col(f"_v{i}").alias(n) for i, n in enumerate(names)])


def _binned(ranges: DataFrame, chr_: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(fine, cells) of ranges: a row for each bin that a range or an end of it touches, and, if there are long ranges, one for
    each cell that is wholly inside one.  A range of n positions makes some n / (BIN * CELL) + 2 * CELL rows at most."""
    extra = [c for c in ranges.columns if c not in ("chr", "start", "end")]
    r = ranges.select(*extra, (F.lit(chr_) if chr_ else plain_chr(F.col("chr"))).alias("_c"), F.col("start").cast("bigint").alias("_s"), F.col("end").cast("bigint").alias("_e")).where("_s <= _e")
    size = BIN * CELL
    long = F.col("_e") - F.col("_s") >= size
    cells = None
    if r.where(long).limit(1).count():
        ends = r.where(long).withColumns({"_a": F.ceil(F.col("_s") / size), "_z": F.floor((F.col("_e") + 1) / size)})
        cells = ends.where("_a < _z").select(*extra, "_c", F.explode(F.sequence(F.col("_a"), F.col("_z") - 1)).alias("_cell")).distinct()
        pair = F.explode(F.array(F.struct(F.col("_s").alias("s"), (F.col("_a") * size - 1).alias("e")), F.struct((F.col("_z") * size).alias("s"), F.col("_e").alias("e")))).alias("_p")
        ends = ends.select(*extra, "_c", pair).select(*extra, "_c", F.col("_p.s").alias("_s"), F.col("_p.e").alias("_e")).where("_s <= _e")
        r = r.where(~long).unionByName(ends)
    return r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / BIN), F.floor(F.col("_e") / BIN)))), cells


def _in_bin(df: DataFrame, fine: DataFrame) -> Column:
    return (plain_chr(df["chr"]) == fine["_c"]) & (F.floor(df["position"] / BIN) == fine["_b"]) & df["position"].between(fine["_s"], fine["_e"])


def _in_cell(df: DataFrame, cells: DataFrame) -> Column:
    return (plain_chr(df["chr"]) == cells["_c"]) & (F.floor(df["position"] / (BIN * CELL)) == cells["_cell"])


def in_ranges(source: DataFrame, ranges: DataFrame, chr_: str | None = None) -> DataFrame:
    """Rows of the source whose position lies in any closed range (chr, start, end), each once.

    Equi-join on (chr, bin) with a residual; of ranges longer than a cell only the ends are binned, the cells inside are
    looked up as such.  Null and empty ranges hold nothing."""
    fine, cells = _binned(ranges.select("chr", "start", "end") if not chr_ else ranges.select("start", "end"), chr_)
    if cells is None:
        return source.join(fine, _in_bin(source, fine), "left_semi")
    # cells are distinct, so the join adds no rows
    marked = source.join(cells.withColumn("_inside", F.lit(True)), _in_cell(source, cells), "left").select(*[source[c] for c in source.columns], "_inside")
    rest = marked.where("_inside is null").drop("_inside")
    return marked.where("_inside").drop("_inside").unionByName(rest.join(fine, _in_bin(rest, fine), "left_semi"))


def by_index(source: DataFrame, index: DataFrame, column: str = "variant_idx") -> DataFrame:
    """Rows of the source whose variant_idx is in a column of ``index``, each once; null indices select nothing."""
    wanted = index.select(F.col(column).alias("_i")).distinct()
    return source.join(wanted, source["variant_idx"] == wanted["_i"], "left_semi")


def add_annotations(variants: DataFrame, source: DataFrame, fields, root: str = "", replace: bool = False) -> DataFrame:
    """Variants with the annotations as a struct ``root`` (or as columns): the table to be written as annotated sink."""
    keys = variants.select(F.col("variant_idx").alias("_row"), "chr", "position", "ref", "alt")
    got = annotate_rows(keys, source, fields)
    names = [c for c in got.columns if c not in ("_row", *KEY)]
    extra = got.select(F.col("_row").alias("variant_idx"), F.struct(*names).alias(root or "_ann"))
    out = variants.join(extra, "variant_idx", "left")
    return out if root else out.select(*[c for c in variants.columns if not (replace and c in names)], "_ann.*")


def write_annotated(path: str, source: DataFrame, fields, root: str = "", replace: bool = False, out: str | None = None, drop: tuple[str, ...] = ()) -> str:
    """The stored table of variants at ``path`` with annotations: in its place, or in a table of its own at ``out``.

    root: name of the struct that holds them (else columns); drop: columns to leave out, such as those of samples.  In place,
    the new table is written beside the old one, which is moved away only then and deleted last: a job that dies leaves
    one of them whole under ``path`` or ``path`` with ``-old``.  Descriptions of the source's fields go with them.
    """
    spark = source.sparkSession
    log.info("annotating %s", path)
    table = spark.read.parquet(path)
    got = add_annotations(table.drop(*drop), source, fields, root, replace)
    if out is not None:
        got.write.mode("errorifexists").parquet(out)
        return out
    path = path.rstrip("/")
    new, old = f"{path}-new", f"{path}-old"
    if path_exists(spark, old):
        raise ValueError(f"{old} is left from an earlier run")
    got.write.mode("overwrite").parquet(new)
    rename(spark, path, old)
    rename(spark, new, path)
    rename(spark, old, None)
    log.info("%s is annotated in its place", path)
    return path
