"""Schemas that drift between files: change log, union schema, and one consistent table.

Each file's header is a small schema.  Schemas are read in parallel, compared with the schema before them in their feed, and
folded through the promotion lattice logical < integer < numeric < character.  A column is the same column across files by
the sense of its description (case, blanks and a closing dot aside); one without a description is known by its name.

The log is ordered by dictionary, feed and file.  Each file's header is laid out once, as the place of every column of the
union schema in the file, so that a line meets its file's layout in one salted join and a value is found by its index.

Defined cases: header rows without a usable name or type are no columns; a header delivered twice counts once; a feed's
first file has no changes; a column without a description is never ``renamed``; among several columns of a file with the
same type and sense, old and new names pair in order.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.rejects import MISSING, TYPES, header_columns, hot_files, loaded, plain_type, with_layout

#: How wide a union schema may become before it is taken for a mistake in the input.
MAX_COLUMNS = 5000


def sense(c: Column) -> Column:
    """A description without case, repeated blanks and a closing dot; '' for null."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return F.regexp_replace(s, r"\A[ .]+|[ .]+\z", "")


def changes(columns: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, change, old_name, new_name) of schemas given as (feed, file_seq, file_id, ordinal, name, type,
    description).

    Two shuffles on (file, name) and (file, type, sense); the order of files comes from the distinct files only.
    """
    cols = columns.select("feed", "file_seq", "file_id", "ordinal", "name", "type", sense(F.col("description")).alias("sense"))
    order = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    files = cols.select("feed", "file_seq", "file_id").distinct()
    after = files.withColumns({"next_id": F.lead("file_id").over(order), "next_seq": F.lead("file_seq").over(order)}).where("next_id is not null").select("file_id", "next_id", "next_seq")
    has_before = files.withColumn("before", F.lag("file_id").over(order)).where("before is not null").select("file_id")
    at, body = ["feed", "file_seq", "file_id"], ["ordinal", "name", "type", "sense"]
    old = cols.join(after, "file_id").select("feed", F.col("next_seq").alias("file_seq"), F.col("next_id").alias("file_id"), *body, F.lit(True).alias("was"))
    new = cols.join(has_before, "file_id").select(*at, *body, F.lit(False).alias("was"))
    side = lambda c, was: F.max(F.when(F.col("was") == was, F.col(c)))
    both = (
        old.unionByName(new)
        .groupBy(*at, "name")
        .agg(*[side(c, w).alias(f"{p}_{c}") for p, w in (("old", True), ("new", False)) for c in ("type", "sense", "ordinal")])
    )
    kept = F.col("old_type").isNotNull() & F.col("new_type").isNotNull()
    retyped = both.where(kept & (F.col("old_type") != F.col("new_type"))).select(*at, F.lit("retyped").alias("change"), F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    single = both.where(~kept).select(
        *at, "name", F.col("old_type").isNotNull().alias("was"), *[F.coalesce(f"old_{c}", f"new_{c}").alias(c) for c in ("type", "sense", "ordinal")]
    )
    # without a sense a column has only its name to be matched by, and that one is gone
    single = single.withColumn("key", F.when(F.col("sense") != "", F.col("sense")).otherwise(F.concat(F.lit("\0"), "name")))
    rank = Window.partitionBy("file_id", "type", "key", "was").orderBy("ordinal", "name")
    pairs = (
        single.withColumn("rn", F.row_number().over(rank))
        .groupBy(*at, "type", "key", "rn")
        .agg(F.max(F.when(F.col("was"), F.col("name"))).alias("o"), F.max(F.when(~F.col("was"), F.col("name"))).alias("n"))
    )
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("renamed")
    moved = pairs.select(*at, change.alias("change"), F.coalesce("o", F.lit("")).alias("old_name"), F.coalesce("n", F.lit("")).alias("new_name"))
    return retyped.unionByName(moved)


def release_columns(dictionary: DataFrame) -> DataFrame:
    """The dictionary of sub-fields by release, in the shape of ``header_columns``; a release is a file."""
    rank = Window.partitionBy("release", "ordinal").orderBy(F.col("name"))
    return (
        dictionary.where("release is not null and ordinal is not null and name is not null")
        .withColumn("rn", F.row_number().over(rank))
        .where("rn = 1")
        .select(
            F.col("release").alias("file_id"), "ordinal", F.lit("").alias("feed"), F.col("release").alias("file_seq"), "name",
            plain_type(F.col("type")).alias("type"), "description", F.col("released_at").alias("delivered_at"),
        )
    )


def change_log(headers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every change of both dictionaries: (dictionary, file_id, change, old_name, new_name), in the order of dictionary, feed, file
    and names."""
    both = [("favor_csv_header", header_columns(headers)), ("vep_output_format", release_columns(dictionary))]
    logs = [changes(c).withColumn("dictionary", F.lit(d)) for d, c in both]
    order = ("dictionary", "feed", "file_seq", "file_id", "old_name", "new_name")
    return logs[0].unionByName(logs[1]).orderBy(*order).select("dictionary", "file_id", "change", "old_name", "new_name")


# ---- union schema


def _identity() -> Column:
    s = sense(F.col("description"))
    return F.when(s != "", s).otherwise(F.concat(F.lit("\0"), F.lower("name")))


def _rank(t: Column) -> Column:
    """Place in the lattice; a text type that is not declared ('' of the sub-fields) is character."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPES)), t).cast("int"), F.lit(0)), F.lit(len(TYPES)))


def union_schema(columns: DataFrame) -> DataFrame:
    """(identity, column_name, type, n_files): schemas of all files folded into one.

    The name is the first one delivered, in lower case; where two identities would share it, later ones get a number.
    Grows with the number of distinct columns, not with files or rows.
    """
    fold = columns.groupBy(_identity().alias("identity")).agg(
        F.max(_rank(F.col("type"))).alias("rank"),
        F.min(F.struct("delivered_at", "file_id", "ordinal", F.lower("name").alias("name"))).alias("first"),
        F.countDistinct("file_id").alias("n_files"),
        F.min(_rank(F.col("type"))).alias("lowest"),
    )
    same = Window.partitionBy("first.name").orderBy("first", "identity")
    name = F.concat("first.name", F.when(F.row_number().over(same) > 1, F.concat(F.lit("_"), F.row_number().over(same).cast("string"))).otherwise(""))
    return fold.select("identity", name.alias("column_name"), F.element_at(F.array(*map(F.lit, TYPES)), F.col("rank")).alias("type"), "n_files", "first", (F.col("lowest") == 1).alias("was_logical"))


def _cast(v: Column, kind: str, was_logical: bool) -> Column:
    """A value that is not missing, in the type of its column; null where it does not fit."""
    if kind == "character":
        return v
    if kind == "logical":
        return F.when(v.isin("TRUE", "T", "YES", "1"), True).when(v.isin("FALSE", "F", "NO", "0"), False)
    # a logical that was promoted to a number counts as 1 or 0
    n = F.when(v == "TRUE", "1").when(v == "FALSE", "0").otherwise(v) if was_logical else v
    return n.try_cast("double" if kind == "numeric" else "bigint")


def _places(columns: DataFrame, schema: DataFrame) -> tuple[DataFrame, list]:
    """(file_id, names, types, places) of each file, and the columns of the union schema in order: places[j] is where column j
    is in the file, from 1, or 0.  The schema is collected: its size is the number of distinct columns, checked against
    MAX_COLUMNS."""
    cols = schema.orderBy("first", "identity").select("identity", "column_name", "type", "was_logical").limit(MAX_COLUMNS + 1).collect()
    if len(cols) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} distinct columns: log them with change_log, or raise MAX_COLUMNS")
    spark = columns.sparkSession
    index = F.broadcast(spark.createDataFrame([(c.identity, j) for j, c in enumerate(cols)], "identity string, j int"))  # of a checked size
    each = columns.withColumn("identity", _identity()).join(index, "identity")
    laid = each.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "type", "j"))).alias("cols"))
    place = F.transform(F.sequence(F.lit(0), F.lit(max(len(cols) - 1, 0))), lambda j: F.array_position(F.col("cols.j"), j).cast("int"))
    return laid.select("file_id", F.col("cols.name").alias("names"), F.col("cols.type").alias("types"), place.alias("places")), cols


def _wide(rows: DataFrame, keep: list[str], cols: list) -> DataFrame:
    """``rows`` holds ``places`` and ``fields``; one typed column per column of the union schema."""
    def cell(place: Column) -> Column:
        value = F.get("fields", place - 1)
        return F.when(~value.isin(*MISSING), value)

    # the generator keeps the cells from being picked again for every use
    rows = rows.select(*keep, F.explode(F.array(F.transform("places", cell))).alias("_cells"))
    out = [F.col(k) for k in keep]
    for j, c in enumerate(cols):
        name = c.column_name if c.column_name not in keep else f"{c.column_name}_"
        out.append(_cast(F.get("_cells", F.lit(j)), c.type, c.was_logical).alias(name))
    return rows.select(*out)


def consistent_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Every line that loads, in the union schema of all files: line_id, file_id, then the columns."""
    columns = header_columns(headers)
    laid, cols = _places(columns, union_schema(columns))
    return _wide(loaded(with_layout(lines, laid, hot_files(lines)), "places"), ["line_id", "file_id"], cols)


def consistent_records(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Annotation records (variant_idx, pos, release, value) in the union schema of all releases.  Short records are padded
    with missing values, further sub-fields of over-long ones stay in the last column.  A dictionary of releases with up to
    MAX_COLUMNS columns each is small; records of one release, however many, are not moved."""
    columns = release_columns(dictionary)
    laid, cols = _places(columns, union_schema(columns))
    layouts = laid.select(F.col("file_id").alias("release"), F.size("names").alias("size"), "places")
    releases = layouts.limit(MAX_COLUMNS + 1).collect()
    small = len(releases) <= MAX_COLUMNS
    rows = records.join(F.broadcast(layouts) if small else layouts, "release")
    # the generator keeps the record from being cut again for every column
    rows = rows.select("*", F.explode(F.array(F.split("value", r"\|", F.col("size")))).alias("fields"))
    return _wide(rows, ["variant_idx", "pos", "release"], cols)
