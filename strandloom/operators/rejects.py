"""Rows that fail to parse: strict load, then anti-join.

Raw records keep their identifier.  The strict load keeps only records that conform in every respect; their identifiers
are subtracted from the raw ones (anti-join); only the remainder is diagnosed, with the first reason that holds.

Defined cases: a null raw line has no columns (``column_count``); an empty line has one empty column; a line whose file
has no usable header has the wrong number of columns; a null or empty column name, or a null type, is a ``bad_value`` of the
header row.  Repeated lines and header rows are judged one by one.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The types a header may name, in the order of promotion.
TYPES = ("logical", "integer", "numeric", "character")
MISSING = ("", "NA", ".")
KEYS = ("variant_vcf", "chromosome", "position", "ref_vcf", "alt_vcf")

FIELD = '"(?:[^"]|"")*+"|[^",]*+'
LINE = rf"\A(?:,(?:{FIELD}))++\z"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
INTEGER = r"\A[+-]?[0-9]+\z"
CHROMOSOME = r"\A(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X|Y)\z"
BASES = r"\A[ACGTNacgtn]+\z"
NAME = r"\A[A-Za-z0-9_.]+\z"
#: A file with more than one in PARTS * cores of all lines is hot: its lines are spread over as many copies of its header as
#: it holds such shares, so that no task gets more than about one share, whatever the size.
PARTS = 4


def plain_type(c: Column) -> Column:
    """A declared type without case and blanks, null as ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\s+|\s+\z", ""))


# ---- header rows


def _header_reason() -> Column:
    text = F.concat_ws("", "column_name", "type", "description")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    usable = F.coalesce(F.col("column_name").rlike(NAME), F.lit(False)) & plain_type(F.col("type")).isin(*TYPES)
    return F.when(quotes % 2 == 1, "quoting").when(~usable, "bad_value")


def usable_rows(headers: DataFrame) -> DataFrame:
    """The strict load of a header table: rows that name a column, duplicates still in."""
    return headers.where(_header_reason().isNull())


def header_columns(headers: DataFrame) -> DataFrame:
    """One row per (file, ordinal): what the file's column is called and typed; the first delivery of a twice delivered
    header (lowest header_id) stands."""
    first = F.min_by(F.struct("feed", "file_seq", "column_name", "type", "description", "delivered_at"), "header_id").alias("c")
    return (
        usable_rows(headers)
        .groupBy("file_id", "ordinal")
        .agg(first)
        .select("file_id", "ordinal", "c.feed", "c.file_seq", F.col("c.column_name").alias("name"), plain_type(F.col("c.type")).alias("type"), "c.description", "c.delivered_at")
    )


def header_rejects(headers: DataFrame) -> DataFrame:
    """(row_id, reason) of header rows that name no usable column."""
    loaded = usable_rows(headers).select("header_id")
    rest = headers.join(loaded, "header_id", "left_anti")
    return rest.select(F.col("header_id").alias("row_id"), F.coalesce(_header_reason(), F.lit("bad_value")).alias("reason"))


# ---- lines


def layouts(headers: DataFrame) -> DataFrame:
    """One row per file: names and types of its columns in order."""
    cols = F.sort_array(F.collect_list(F.struct("ordinal", "name", "type")))
    return header_columns(headers).groupBy("file_id").agg(cols.alias("cols")).select("file_id", F.col("cols.name").alias("names"), F.col("cols.type").alias("types"))


def hot_files(lines: DataFrame) -> DataFrame:
    """(file_id, salts) of the files that hold more than a fair share of the lines; at most PARTS * cores rows, small enough for
    every task.  Reads the column of file numbers only."""
    spark = lines.sparkSession
    shares = PARTS * spark.sparkContext.defaultParallelism
    sizes = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("file_id is not null")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = sizes.where(F.col("n") * shares > total).select("file_id", F.ceil(F.col("n") * shares / F.lit(max(total, 1))).cast("int").alias("salts")).collect()
    return spark.createDataFrame([(r.file_id, r.salts) for r in rows], "file_id int, salts int")


def with_layout(lines: DataFrame, laid: DataFrame, hot: DataFrame) -> DataFrame:
    """Lines beside what ``laid`` holds about their file (one row a file); null where it holds nothing."""
    hot = F.broadcast(hot)  # of a bounded size
    salts = F.coalesce("salts", F.lit(1))
    copies = laid.join(hot, "file_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    mine = lines.select("line_id", "file_id", "raw").join(hot, "file_id", "left").withColumn("salt", F.pmod(F.xxhash64("line_id"), salts).cast("int")).drop("salts")
    # headers grow with the number of files: they are hashed partition by partition, never sent whole to every task
    return mine.join(copies.hint("shuffle_hash"), ["file_id", "salt"], "left").drop("salt")


def _fields(raw: Column) -> Column:
    """The values of a line that keeps the CSV rules, unquoted."""
    found = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(f",({FIELD})"), F.lit(1))
    return F.transform(found, lambda v: F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))


def _value_ok() -> Column:
    def at(name: str) -> Column:
        return F.coalesce(F.get("fields", F.array_position("names", name).cast("int") - 1), F.lit(""))

    plain = lambda c: F.regexp_replace(F.lower(c), r"\Achr", "")
    position = F.expr("try_cast(coalesce(get(fields, cast(array_position(names, 'position') as int) - 1), '') as decimal(38,0))")
    parts = F.split(at("variant_vcf"), "[-_:]", -1)
    keys = (
        at("chromosome").rlike(CHROMOSOME)
        & at("position").rlike(r"\A[0-9]+\z")
        & F.coalesce(position.between(1, 2**31 - 1), F.lit(False))
        & at("ref_vcf").rlike(BASES)
        & at("alt_vcf").rlike(BASES)
        & (F.size(parts) == 4)
    )
    same = (plain(F.get(parts, F.lit(0))) == plain(at("chromosome"))) & (F.get(parts, F.lit(1)) == at("position"))
    for i, name in ((2, "ref_vcf"), (3, "alt_vcf")):
        same = same & (F.lower(F.get(parts, F.lit(i))) == F.lower(at(name)))

    def fits(x: Column) -> Column:
        v, t = x["v"], x["t"]
        typed = F.when(t == "numeric", v.rlike(NUMBER)).when(t == "integer", v.rlike(INTEGER)).when(t == "logical", v.isin("TRUE", "FALSE")).otherwise(True)
        return x["n"].isin(*KEYS) | v.isin(*MISSING) | typed

    zipped = F.arrays_zip(F.col("fields").alias("v"), F.col("names").alias("n"), F.col("types").alias("t"))
    return F.coalesce(keys & same, F.lit(False)) & F.forall(zipped, fits)


def _judged(laid: DataFrame) -> DataFrame:
    """Lines with their fields and ok_quotes, ok_count, ok_values; later checks are false where earlier ones fail."""
    good = F.coalesce(F.concat(F.lit(","), F.col("raw")).rlike(LINE), F.col("raw").isNull())
    fields = F.when(F.col("ok_quotes") & F.col("raw").isNotNull(), _fields(F.col("raw"))).otherwise(F.array().cast("array<string>"))
    judged = laid.withColumn("ok_quotes", good)
    # a generator keeps filters from being pushed below and the fields from being cut again for every use
    judged = judged.select("*", F.explode(F.array(fields)).alias("fields"))
    judged = judged.withColumn("ok_count", F.coalesce(F.col("ok_quotes") & (F.size("fields") == F.size("names")) & (F.size("names") > 0), F.lit(False)))
    return judged.withColumn("ok_values", F.when(F.col("ok_count"), _value_ok()).otherwise(False))


def loaded(laid_lines: DataFrame, *more: str) -> DataFrame:
    """Of lines with their layout, those that fit it: (line_id, file_id, names, types, fields) and ``more`` of the layout."""
    return _judged(laid_lines).where("ok_values").select("line_id", "file_id", "names", "types", "fields", *more)


def load_lines(lines: DataFrame, headers: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Strict load: (line_id, file_id, names, types, fields) of the lines that fit their file's header."""
    return loaded(with_layout(lines, layouts(headers), hot_files(lines) if hot is None else hot))


def line_rejects(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(row_id, reason) of the lines that the strict load leaves over."""
    hot = hot_files(lines)
    rest = lines.join(load_lines(lines, headers, hot).select("line_id"), "line_id", "left_anti")
    reason = F.when(~F.col("ok_quotes"), "quoting").when(~F.col("ok_count"), "column_count").otherwise("bad_value")
    return _judged(with_layout(rest, layouts(headers), hot)).select(F.col("line_id").alias("row_id"), reason.alias("reason"))
