"""Variant call files: reader, importers for the common annotators, writer.

The header is read on the driver, to its end; lines are split and typed on the executors in one map-only pass, and INFO is cut
into its fields once a line.  Rows get a consecutive ``variant_idx``: files in the order of their paths, rows in the order of
the file, from the counts of the pieces in which files are read.

Defined cases: a field of INFO that comes twice counts as it comes first; a missing value is ``.`` or nothing; a line of fewer
than eight fields has null for the missing ones; files without rows give no rows.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import dictionaries as D
from strandloom.functions import annotation as A
from strandloom.session import cut

log = logging.getLogger(__name__)

TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean"}


@dataclass
class Header:
    """Meta lines as (id, value) and the fields of INFO as name -> (number, type, description)."""

    meta: list[tuple[str, str]] = field(default_factory=list)
    infos: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        out = cls()
        for line in lines:
            if not line.startswith("##"):
                continue
            key, _, value = line[2:].partition("=")
            out.meta.append((key, value))
            if key == "INFO":
                parts = dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,>]*)', value))
                if "ID" in parts:
                    out.infos[parts["ID"]] = (parts.get("Number", "."), parts.get("Type", "String"), parts.get("Description", '""').strip('"'))
        return out

    def get(self, key: str) -> str | None:
        """The first meta line of that id."""
        return next((v for k, v in self.meta if k == key), None)

    def names(self, root: str) -> list[str]:
        """Sub-fields that a description lists: after the last ``Format:``, or between single quotes."""
        text = self.infos[root][2]
        if "Format:" in text:
            return [n.strip() for n in text.rpartition("Format:")[2].split("|")]
        quoted = re.search(r"'(.*)'", text)
        return [re.sub(r"[\s']", "", n).replace("/", "-") for n in (quoted[1] if quoted else "").split("|") if n.strip()]


def read_header(spark: SparkSession, path: str) -> Header:
    """All lines up to the first one that is no header line, however many."""
    lines, n, text = [], 1000, spark.read.text(path)
    while True:
        lines = [r.value for r in text.take(n)]
        head = next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines))
        if head < len(lines) or len(lines) < n:
            return Header.parse(lines[:head])
        n *= 8


def numbered(df: DataFrame, name: str = "variant_idx") -> DataFrame:
    """Consecutive numbers from 1 in the order of the partitions, such as those of a sorted table, from their counts.

    The table is made once and stored, then counted and numbered: one made twice is cut anew, as a sort draws its bounds from
    what comes first and adaptive execution merges partitions by their bytes, which are fewer where only rows are counted."""
    return _numbered(cut(df).withColumn("_at", F.spark_partition_id()), ["_at"], name)


def numbered_files(parts: list[DataFrame], name: str = "variant_idx") -> DataFrame:
    """Consecutive numbers from 1 over reads of files: reads in the order of the list, files of a read in the order of their
    paths, rows in the order of the file.  Spark deals out pieces of files by size, not by name, so that each piece is
    counted and placed by its path and by where it begins."""
    out = None
    for i, p in enumerate(parts):
        p = p.select("*", F.struct(F.lit(i).alias("i"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("_at"))
        out = p if out is None else out.unionByName(p)
    return _numbered(out, ["_at.i", "_at.path", "_at.start"], name)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    pieces = marked.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    # one row a piece of the read: the window and the broadcast are as small as that list
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = pieces.select("_at", "_n", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    rank = F.col("_m") - F.col("_first")
    # both reads must cut the files alike; if they do not, because executors came or went, the numbers would be wrong
    at = F.when(rank.between(F.lit(0), F.col("_n") - 1), F.col("_before") + rank + 1).otherwise(F.raise_error(F.lit("files were cut anew while rows were numbered: read them again")))
    return marked.join(F.broadcast(offsets), "_at", "left").withColumn(name, at.cast("bigint")).drop("_at", "_m", "_n", "_first", "_before")


def _info(key: str) -> Column:
    return F.nullif(F.get("_values", F.array_position("_keys", F.lit(key)).cast("int") - 1), F.lit(""))


def _value(key: str, number: str, kind: str) -> Column:
    if kind == "Flag":
        return F.array_contains("_keys", F.lit(key))
    t = TYPES.get(kind, "string")
    one = lambda c: A.typed(F.nullif(c, F.lit(".")), t)
    return one(_info(key)) if number in ("1", "0") or kind == "Character" else F.transform(F.split(_info(key), ","), one)


def read(spark: SparkSession, path: str, keep: list[str] | None = None, raw: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """(variant_idx, chr, position, id, ref, alt, allele, qual, filter, info): ``keep`` names fields of INFO (all), ``raw`` those left
    as text, ``drop`` those left out.  Missing values ('.') are null."""
    header = read_header(spark, path)
    log.info("%s: %d header lines, %d fields of INFO", path, len(header.meta), len(header.infos))
    lines = numbered_files([spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))])
    # generators keep a line from being cut again for every one of its fields
    lines = lines.select("variant_idx", F.explode(F.array(F.split("value", "\t", 9))).alias("_p"))
    p = [F.get("_p", F.lit(i)) for i in range(8)]
    miss = lambda c: F.nullif(c, F.lit("."))
    rows = lines.select(
        "variant_idx", p[0].alias("chr"), p[1].try_cast("int").alias("position"), miss(p[2]).alias("id"), p[3].alias("ref"), p[4].alias("alt"),
        F.concat_ws(",", p[3], p[4]).alias("allele"), A.number(p[5]).cast("float").alias("qual"), miss(p[6]).alias("filter"), F.coalesce(miss(p[7]), F.lit("")).alias("_info"),
    )
    if keep is None or keep:
        rows = rows.select("*", F.explode(F.array(F.split("_info", ";"))).alias("_each"))
        rows = rows.select("*", F.transform("_each", lambda x: F.substring_index(x, "=", 1)).alias("_keys"), F.transform("_each", lambda x: F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1))).alias("_values"))
    fields = []
    for key, (number, kind, text) in header.infos.items():
        if (keep is None or key in keep) and key not in drop:
            c = _info(key) if key in raw else _value(key, number, kind)
            fields.append(c.alias(key, metadata={"comment": text, "number": number, "type": kind}))
    info = F.struct(*fields).alias("info") if fields else F.lit(None).cast("struct<_none:string>").alias("info")
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], info)


def _split_records(packed: Column, names: list[str], kind_of, strip: bool = False) -> Column:
    """array<struct> of comma-separated piped records."""

    def one(rec: Column) -> Column:
        parts = A.pieces(F.regexp_replace(rec, r"^\(|\)$", "") if strip else rec, len(names))
        # one cut a record: the inner array holds the pieces for all of its fields
        return F.transform(F.array(parts), lambda p: F.struct(*[A.typed(F.get(p, F.lit(i)), kind_of(n)).alias(n, metadata={"comment": D.about(n)}) for i, n in enumerate(names)]))[0]

    return F.transform(F.split(packed, ","), one)


def import_plain(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path)


def import_vep(spark: SparkSession, path: str, root: str = "CSQ", keep: bool = False) -> DataFrame:
    """Adds ``root`` as struct<uniform, list>: fields with one value per variant come from its first record; a variant without
    records has null for both.  keep: leave the packed field in info."""
    header = read_header(spark, path)
    names = header.names(root)
    df = read(spark, path, raw=(root,))
    packed = F.col(f"info.{root}")
    uniform = [n for n in names if D.vep_uniform(n)]
    records = _split_records(packed, names, D.vep_type)
    first = F.get(records, F.lit(0))
    parts = [F.transform(records, lambda r: F.struct(*[r[n].alias(n) for n in names if n not in uniform])).alias("list")]
    if uniform:
        parts.append(F.when(packed.isNotNull(), F.struct(*[first[n].alias(n) for n in uniform])).alias("uniform"))
    return _finish(df.withColumn(root, F.struct(*parts)), [root], keep)


def import_snpeff(spark: SparkSession, path: str, roots: tuple[str, ...] = ("ANN", "LOF", "NMD"), keep: bool = False) -> DataFrame:
    """Adds each root that the header has as array<struct>; parentheses around LOF and NMD records are dropped."""
    header = read_header(spark, path)
    roots = tuple(r for r in roots if r in header.infos)
    df = read(spark, path, raw=roots)
    for r in roots:
        df = df.withColumn(r, _split_records(F.col(f"info.{r}"), header.names(r), D.snpeff_type, strip=r != "ANN"))
    return _finish(df, list(roots), keep)


def import_annovar(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    r"""Types by dictionary, \xHH decoded, bookkeeping dropped; without keep the gene-model fields are dropped too."""
    header = read_header(spark, path)
    drop = [k for k in header.infos if k in D.ANNOVAR_MARKS or (not keep and k.startswith(D.ANNOVAR_GENE_PREFIXES))]
    names = [k for k in header.infos if k not in drop]
    df = read(spark, path, raw=tuple(n for n in names if header.infos[n][1] != "Flag"), drop=tuple(drop))
    cols = []
    for n in names:
        number, kind, text = header.infos[n]
        c = F.col(f"info.`{n}`")
        if kind != "Flag":
            t = D.annovar_type(n)
            c = A.typed(F.nullif(A.decode_hex(c), F.lit(".")), t if t != "string" else TYPES.get(kind, "string"))
        cols.append(c.alias(n, metadata={"comment": text or D.about(n)}))
    return df.withColumn("info", F.struct(*cols)) if cols else df


def _finish(df: DataFrame, roots: list[str], keep: bool) -> DataFrame:
    if keep:
        return df
    left = [n for n in df.schema["info"].dataType.names if n not in roots]
    return df.withColumn("info", F.col("info").dropFields(*roots)) if left else df.drop("info")


def write(df: DataFrame, path: str, infos: dict[str, tuple[Column, str, str, str]], meta: list[tuple[str, str]] = ()) -> None:
    """Lines of a variant call file, in parts, with the header at the head of each: infos is name -> (column, number, type,
    description).  ``df`` has chr, position, id, ref, alt, qual, filter."""
    head = ["##fileformat=VCFv4.2", *(f"##{k}={v}" for k, v in meta)]
    head += [f'##INFO=<ID={k},Number={n},Type={t},Description="{text}">' for k, (_, n, t, text) in infos.items()]
    head.append("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")
    dot = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))
    parts = [F.when(c, F.lit(k)) if t == "Flag" else F.concat(F.lit(f"{k}="), F.nullif(c.cast("string"), F.lit(""))) for k, (c, _, t, _d) in infos.items()]
    line = F.concat_ws("\t", dot(F.col("chr")), dot(F.col("position")), dot(F.col("id")), dot(F.col("ref")), dot(F.col("alt")), dot(F.col("qual")), dot(F.col("filter")), dot(F.concat_ws(";", *parts)))

    def headed(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head, b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    df.select(line.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)
