"""Wide annotation databases delivered as CSV, single, in several files or in a tar archive."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.dictionaries import FAVOR_TYPES, about
from strandloom.functions import annotation as A
from strandloom.operators.rejects import KEYS
from strandloom.session import cut, ship
from strandloom.sources.vcf import numbered_files

SPARK_TYPES = {"numeric": "float", "integer": "int", "logical": "boolean", "character": "string"}


def _finish(df: DataFrame, types: dict[str, str], id_column: str | None, filter_: str | None, root: str, doubles: bool) -> DataFrame:
    kinds = SPARK_TYPES | ({"numeric": "double"} if doubles else {})

    def cast(n: str):
        k, c = kinds[types.get(n, "character")], F.when(~F.col(f"`{n}`").isin("", "NA", "."), F.col(f"`{n}`"))
        return (A.logical(c) if k == "boolean" else A.typed(c, k)).alias(n, metadata={"comment": about(n)})

    fields = [cast(n) for n in df.columns if n not in (*KEYS, "vid", "variant_idx")]
    info = F.struct(*fields)
    if root:
        info = F.struct(info.alias(root))
    return df.select(
        "variant_idx", F.col("chromosome").alias("chr"), F.col("position").try_cast("int").alias("position"), F.col("ref_vcf").alias("ref"), F.col("alt_vcf").alias("alt"),
        F.concat_ws(",", "ref_vcf", "alt_vcf").alias("allele"), (F.coalesce(F.col(id_column), F.lit("")) if id_column in df.columns else F.lit("")).alias("id"),
        F.lit(None).cast("float").alias("qual"), F.lit(filter_).cast("string").alias("filter"), info.alias("info"),
    )


def header_of(spark: SparkSession, path: str) -> list[str]:
    return next(csv.reader([spark.read.text(path).first().value]))


def _check(names: list[str]) -> None:
    if len(set(names)) < len(names):
        raise ValueError("a column comes twice")
    if missing := set(KEYS) - set(names):
        raise ValueError(f"missing columns: {sorted(missing)}")


def read_csv(spark: SparkSession, paths: list[str], types: dict[str, str] = FAVOR_TYPES, root: str = "FAVOR", doubles: bool = False, id_column: str = "variant_vcf", filter_: str | None = "PASS") -> DataFrame:
    """CSV files with one header between them; variants numbered over all files in order."""
    headers = [header_of(spark, p) for p in paths]
    if any(h != headers[0] for h in headers):
        raise ValueError("the files have different columns")
    _check(headers[0])
    schema = ", ".join(f"`{n}` string" for n in headers[0])
    parts = [spark.read.schema(schema).option("header", True).option("escape", '"').csv(p) for p in paths]
    return _finish(numbered_files(parts), types, id_column, filter_, root, doubles)


def read_tar(spark: SparkSession, path: str, types: dict[str, str] = FAVOR_TYPES, root: str = "", doubles: bool = False, members: list[str] | None = None) -> DataFrame:
    """CSV members of a tar archive in the order of the number after the last underscore; every column must be known to
    ``types``.  An archive is one stream: one task unpacks it, once, into lines on shared storage, and all tasks read those.
    A value holds no line end."""
    ship(spark)

    def unpack(batches):
        import tarfile

        import pyarrow as pa

        from strandloom.sources.footers import open_file

        schema = pa.schema([("member", pa.string()), ("line", pa.int64()), ("raw", pa.string())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with open_file(uri) as source, tarfile.open(fileobj=source, mode="r|*") as tar:
                    for m in tar:
                        if not m.isfile() or not m.name.endswith(".csv") or (members and m.name not in members):
                            continue
                        text, at = tar.extractfile(m), 0
                        while lines := text.readlines(4 << 20):
                            raw = [y.decode("utf-8", "replace") for x in lines if (y := x.rstrip(b"\r\n"))]
                            yield pa.RecordBatch.from_arrays([pa.array([m.name] * len(raw)), pa.array(range(at, at + len(raw))), pa.array(raw)], schema=schema)
                            at += len(raw)

    one = spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(unpack, "member string, line bigint, raw string")
    lines = cut(one.repartition(spark.sparkContext.defaultParallelism, "member", "line"))
    heads = lines.where("line = 0").select("member", "raw").collect()  # one row a member
    if not heads:
        raise ValueError(f"no member ending in .csv in {path}")
    names = [next(csv.reader([h.raw])) for h in heads]
    if any(n != names[0] for n in names):
        raise ValueError("the files have different columns")
    _check(names[0])
    if unknown := set(names[0]) - set(types) - {*KEYS, "vid"}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    sizes = {r.member: r.n for r in lines.where("line > 0").groupBy("member").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = lambda n: (int(m[1]) if (m := re.search(r"_(\d+)\.csv$", n)) else 0, n)
    before, at = {}, 0
    for n in sorted((h.member for h in heads), key=place):
        before[n], at = at, at + sizes.get(n, 0)
    schema = ", ".join(f"`{n}` string" for n in names[0])
    offset = F.element_at(F.create_map(*[x for n, b in before.items() for x in (F.lit(n), F.lit(b))]), F.col("member"))
    rows = lines.where("line > 0").select((offset + F.col("line")).cast("bigint").alias("variant_idx"), F.explode(F.array(F.from_csv("raw", F.lit(schema), {"escape": '"'}))).alias("x"))
    return _finish(rows.select("variant_idx", "x.*"), types, "rsid", None, root, doubles)
