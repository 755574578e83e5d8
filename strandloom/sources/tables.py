"""Sinks and checks of imported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructField, StructType, TimestampType

from strandloom.session import path_exists


def open_tables(spark: SparkSession, paths: list[str] | str, one_chromosome: bool = False) -> DataFrame:
    """Annotation tables as one, ``file_idx`` from the order of the list; a path given twice is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no annotation table")
    if len(set(paths)) < len(paths):
        raise ValueError("a table is given twice")
    out = None
    for i, p in enumerate(paths):
        if not path_exists(spark, p):
            raise FileNotFoundError(p)
        df = spark.read.parquet(p).withColumn("file_idx", F.lit(i))
        if missing := {"chr", "position", "ref", "alt"} - set(df.columns):
            raise ValueError(f"{p} is no table of variants: it lacks {sorted(missing)}")
        if one_chromosome and len(df.select("chr").distinct().limit(2).collect()) > 1:
            raise ValueError(f"more than one chromosome in {p}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Columns of a table of variants; annotations are leaves of ``info`` or structs beside it.
VARIANTS = "variant_idx bigint, chr string, position int, ref string, alt string, allele string, id string, qual float, filter string"
CODECS = ("zstd", "gzip", "snappy", "none")


def empty_table(spark: SparkSession, info: str = "") -> DataFrame:
    """A table of variants without rows; ``info`` lists the fields of its info struct, if any."""
    return spark.createDataFrame([], VARIANTS + (f", info struct<{info}>" if info else ""))


def write_table(df: DataFrame, path: str, compression: str = "zstd", partition: bool = True) -> None:
    """Parquet, partitioned by chromosome and sorted by position within files, so that extrema prune row groups."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression}")
    if partition:
        # by range: a chromosome with a third of all rows is spread over many tasks
        df = df.repartitionByRange("chr", "position").sortWithinPartitions("chr", "position")
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy("chr") if partition else writer).parquet(path)


def _leaves(schema: StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], DataType]]:
    """(path, type) of all leaf columns; lists and maps are leaves."""
    out = []
    for f in schema.fields:
        out += _leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [((*path, f.name), f.dataType)]
    return out


def _column(path: tuple[str, ...]) -> Column:
    return F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))


_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _to_text(c: Column, t: DataType) -> Column:
    if isinstance(t, (ArrayType, MapType)):
        c = F.to_json(c)
    elif isinstance(t, BinaryType):
        c = F.base64(c)
    elif isinstance(t, TimestampType):
        c = F.date_format(c, _STAMP)
    c = c.cast("string")
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _from_text(c: Column, t: DataType) -> Column:
    def plain(x: Column) -> Column:
        for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\0", "\0")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    c = F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")
    if isinstance(t, (ArrayType, MapType)):
        return F.from_json(c, t)
    if isinstance(t, BinaryType):
        return F.unbase64(c)
    return F.to_timestamp(c, _STAMP) if isinstance(t, TimestampType) else c.cast(t)


#: One row a line: no value holds a tab or a line end, so that lines can be split as they stand.
_TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    r"""Flat text of all leaf columns, named by their path (``info.CSQ``).

    Null is an empty field, an empty text is ``""``.  Backslash, tab, line ends and NUL are written as \\, \t, \n, \r and \0;
    blanks at the ends stay.  Lists and maps are JSON, binary is base64, instants carry their offset.  A null struct is
    written as null leaves."""
    leaves = [_to_text(_column(p), t).alias(".".join(p)) for p, t in _leaves(df.schema)]
    df.select(*leaves).write.mode("overwrite").options(**_TSV, nullValue="", emptyValue='""', compression=compression).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_tsv`` wrote of a table of that schema, as flat leaf columns named by their path."""
    leaves = _leaves(schema)
    text = StructType([StructField(".".join(p), StringType()) for p, _ in leaves])
    # the reader takes for null what equals nullValue, empty texts too if it is empty; no field holds a lone \\N
    raw = spark.read.schema(text).options(**_TSV, nullValue="\\N", emptyValue="").csv(path)
    return raw.select(*[_from_text(F.col(f"`{name}`"), t).alias(name) for name, (_, t) in zip(raw.columns, leaves)])


def digests(df: DataFrame) -> DataFrame:
    """(column_name, digest): an order-free digest of each column's values beside their row's variant_idx: the sum of the first
    32 bits of the MD5 of both as text; null differs from every text."""
    each = lambda c: F.md5(F.concat_ws("|", F.col("variant_idx").cast("string"), F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")))).substr(1, 8)
    sums = [F.sum(F.conv(each(c), 16, 10).cast("bigint")).alias(c) for c in df.columns if c != "variant_idx"]
    row = df.agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("digest")) for c in row.columns]))
    return row.select(pairs.alias("x")).select("x.*")
