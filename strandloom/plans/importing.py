"""Queries of readers, writers, reports and streams: tables go out in a format, come in again, and are compared."""

from __future__ import annotations

import os
import tarfile
import uuid

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import annotation as A
from strandloom.operators import lookup, report, stats
from strandloom.plans.annotation import _COUNTERS, _FIRST, _OF_VARIANTS, _QUAL, _apart, _apart_sql, _source
from strandloom.session import checkpoint_dir, read, ship
from strandloom.sources import favor, tables, vcf
from strandloom.sources.footers import file_system
from strandloom.streaming import counters

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "variants").where("chr is not null and position is not null and ref <> '' and alt <> ''").select("variant_idx", "chr", "position", "id", "ref", "alt", "qual", "filter", "info")


_MISS = "nullif(nullif({0}, ''), '.')"
_WHERE = "where chr is not null and position is not null and ref <> '' and alt <> ''"


@query(f"select chr, position, {_MISS.format('id')} as id, ref, alt, {_MISS.format('filter')} as filter, case when isfinite(info.cadd_phred) then info.cadd_phred end as cadd, coalesce(info.was_mixed, false) as mixed, variant_idx as vid from variants {_WHERE}")
def vcf_roundtrip(spark, d):
    """Plain INFO fields: integer, float and flag."""
    ship(spark)
    out, v = _folder(spark, "vcf"), _plain(spark, d)
    number = F.when(F.abs("info.cadd_phred") < float("inf"), F.col("info.cadd_phred"))
    infos = {"VID": (F.col("variant_idx"), "1", "Float", "number"), "CADD": (F.when(~F.isnan(number), number), "1", "Float", "score"), "MIXED": (F.coalesce("info.was_mixed", F.lit(False)), "0", "Flag", "mixed")}
    vcf.write(v, out, infos | {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number as text")})
    got = vcf.import_plain(spark, out)
    return got.select("chr", "position", "id", "ref", "alt", "filter", F.col("info.CADD").alias("cadd"), F.col("info.MIXED").alias("mixed"), F.col("info.VIDS").cast("bigint").alias("vid"))


@query("select coalesce(nullif(chr, ''), '.') as chr, position, nullif(nullif(id, ''), '.') as id, coalesce(nullif(ref, ''), '.') as ref, coalesce(nullif(alt, ''), '.') as alt, nullif(nullif(filter, ''), '.') as filter, variant_idx as vid from variants")
def vcf_all_rows(spark, d):
    """Every variant, those that lack a key included."""
    ship(spark)
    out = _folder(spark, "vcf")
    vcf.write(read(spark, d, "variants"), out, {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number as text")})
    return vcf.import_plain(spark, out).select("chr", "position", "id", "ref", "alt", "filter", F.col("info.VIDS").cast("bigint").alias("vid"))


_SUB = ("Allele", "Consequence", "IMPACT", "SYMBOL", "DISTANCE", "AF")


def _with_records(spark: SparkSession, d: str, fields: list) -> DataFrame:
    """Variants with their records packed in order of record_no."""
    clean = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[|,;=\s]", "_") for c in fields]
    r = read(spark, d, "records").select("variant_idx", F.struct("record_no", F.concat_ws("|", *clean).alias("t")).alias("r"))
    packed = r.groupBy("variant_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["t"]), ",").alias("packed"))
    return _plain(spark, d).join(packed, "variant_idx", "left")


_CLEAN = r"regexp_replace(coalesce({0}::varchar, ''), '[|,;=\s]', '_', 'g')"


@query(f"select v.variant_idx as vid, {_CLEAN.format('gene')} as symbol, {_CLEAN.format('impact')} as impact, record_no as distance from records r join (select * from variants {_WHERE}) v using (variant_idx)")
def import_vep(spark, d):
    """CSQ records come back as typed sub-fields; AF, one value a variant, from the first record."""
    ship(spark)
    out = _folder(spark, "vep")
    df = _with_records(spark, d, [F.lit("A"), F.col("consequence"), F.col("impact"), F.col("gene"), F.col("record_no"), F.lit("0.5")])
    desc = "Consequence annotations. Format: " + "|".join(_SUB)
    vcf.write(df, out, {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number"), "CSQ": (F.col("packed"), ".", "String", desc)})
    got = vcf.import_vep(spark, out).select(F.col("info.VIDS").cast("bigint").alias("vid"), F.explode("CSQ.list").alias("c"))
    return got.select("vid", F.col("c.SYMBOL").alias("symbol"), F.col("c.IMPACT").alias("impact"), F.col("c.DISTANCE").alias("distance"))


@query(f"select v.variant_idx as vid, count(*) as n_records, max({_CLEAN.format('feature')}) as last_feature from records r join (select * from variants {_WHERE}) v using (variant_idx) group by 1")
def import_snpeff(spark, d):
    ship(spark)
    out = _folder(spark, "snpeff")
    df = _with_records(spark, d, [F.lit("A"), F.col("consequence"), F.col("impact"), F.col("gene"), F.col("feature"), F.lit("")])
    desc = "Functional annotations: 'Allele | Annotation | Annotation_Impact | Gene_Name | Feature_ID | ERRORS / WARNINGS / INFO'"
    vcf.write(df, out, {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number"), "ANN": (F.col("packed"), ".", "String", desc)})
    got = vcf.import_snpeff(spark, out).where("ANN is not null")
    return got.select(F.col("info.VIDS").cast("bigint").alias("vid"), F.size("ANN").cast("bigint").alias("n_records"), F.array_max(F.transform("ANN", lambda r: r["Feature_ID"])).alias("last_feature"))


@query(f"select v.variant_idx as vid, {_CLEAN.format('gene')} as gene, record_no as n_transcripts, 0.5::float as share, 'LOF' as root from records r join (select * from variants {_WHERE}) v using (variant_idx) union all select v.variant_idx, {_CLEAN.format('feature')}, record_no, 0.25::float, 'NMD' from records r join (select * from variants {_WHERE}) v using (variant_idx)")
def import_snpeff_lof(spark, d):
    """LOF and NMD records, in parentheses, beside a header that has no ANN."""
    ship(spark)
    out = _folder(spark, "lof")
    desc = "'Gene_Name | Gene_ID | Number_of_transcripts_in_gene | Percent_of_transcripts_affected'"
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[|,;=\s]", "_")
    piped = lambda c, share: F.concat(F.lit("("), F.concat_ws("|", clean(c), F.lit("id"), F.col("record_no").cast("string"), F.lit(share)), F.lit(")"))
    r = read(spark, d, "records").groupBy("variant_idx").agg(F.array_join(F.collect_list(piped("gene", "0.5")), ",").alias("lof"), F.array_join(F.collect_list(piped("feature", "0.25")), ",").alias("nmd"))
    df = _plain(spark, d).join(r, "variant_idx", "left")
    vcf.write(df, out, {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number"), "LOF": (F.col("lof"), ".", "String", desc), "NMD": (F.col("nmd"), ".", "String", desc)})
    got = vcf.import_snpeff(spark, out)
    each = F.explode(F.array(F.struct(F.lit("LOF").alias("root"), F.col("LOF").alias("rs")), F.struct(F.lit("NMD").alias("root"), F.col("NMD").alias("rs")))).alias("x")
    rows = got.select(F.col("info.VIDS").cast("bigint").alias("vid"), each).select("vid", "x.root", F.explode("x.rs").alias("r"))
    return rows.select("vid", F.col("r.Gene_Name").alias("gene"), F.col("r.Number_of_transcripts_in_gene").alias("n_transcripts"), F.col("r.Percent_of_transcripts_affected").alias("share"), "root")


_SLOTS = ("consequence", "impact", "gene", "feature", "feature_type", "biotype", "sift", "polyphen", "errors")
_IMPORTED = "with records as (select v.variant_idx, " + ", ".join(f"{_CLEAN.format('r.' + c)} as {c}" for c in _SLOTS) + f" from records r join (select * from variants {_WHERE}) v using (variant_idx)) "
_STATS = ("n_annot", "cons_all", "region", "func_class", "cons_severe", "impact_severe", "impact", "biotype", "feature_type", "feature", "gene_impact")


def _stats_sql(names: tuple[str, ...]) -> str:
    """Counters of the records as they come out of a file."""
    return _IMPORTED.replace("from records r", "from main.records r") + " union all ".join(f"select '{n}' as stat, category, n from ({_COUNTERS[n]})" for n in names) + f" union all select 'n_var', 'n', count(*) from variants {_WHERE}"


@query(f"select v.variant_idx as vid, n.n_records, 'SNV' as class, 0.5::float as af from (select * from variants {_WHERE}) v join (select variant_idx, count(*) as n_records from records group by 1) n using (variant_idx)")
def import_vep_uniform(spark, d):
    """Fields with one value per variant come beside the list of the others."""
    ship(spark)
    out = _folder(spark, "vep")
    df = _with_records(spark, d, [F.lit("A"), F.col("consequence"), F.lit("SNV"), F.lit("0.5")])
    vcf.write(df, out, {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number"), "CSQ": (F.col("packed"), ".", "String", "From a tool. Format: Allele|Consequence|VARIANT_CLASS|AF")})
    got = vcf.import_vep(spark, out).where("CSQ.uniform is not null")
    return got.select(F.col("info.VIDS").cast("bigint").alias("vid"), F.size("CSQ.list").cast("bigint").alias("n_records"), F.col("CSQ.uniform.VARIANT_CLASS").alias("class"), F.col("CSQ.uniform.AF").alias("af"))


@query(_stats_sql((*_STATS, "sift", "polyphen")))
def stat_from_vep(spark, d):
    """A file of VEP is imported and counted: its records, and its variants by the most severe one."""
    ship(spark)
    out = _folder(spark, "vep")
    df = _with_records(spark, d, [F.lit("A"), *map(F.col, ("consequence", "impact", "gene", "feature", "feature_type", "biotype", "sift", "polyphen")), F.lit("0.5")])
    desc = "From a tool. Format: Allele|Consequence|IMPACT|SYMBOL|Feature|Feature_type|BIOTYPE|SIFT|PolyPhen|AF"
    vcf.write(df, out, {"CSQ": (F.col("packed"), ".", "String", desc)})
    return stats.annotated_counters(vcf.import_vep(spark, out)).where(F.col("stat").isin("n_var", *_STATS, "sift", "polyphen"))


@query(_stats_sql((*_STATS, "errors")))
def stat_from_snpeff(spark, d):
    ship(spark)
    out = _folder(spark, "snpeff")
    df = _with_records(spark, d, [F.lit("A"), *map(F.col, ("consequence", "impact", "gene", "feature", "feature_type", "biotype", "errors"))])
    desc = "Functional annotations: 'Allele | Annotation | Annotation_Impact | Gene_Name | Feature_ID | Feature_Type | Transcript_BioType | ERRORS / WARNINGS / INFO'"
    vcf.write(df, out, {"ANN": (F.col("packed"), ".", "String", desc)})
    return stats.annotated_counters(vcf.import_snpeff(spark, out)).where(F.col("stat").isin("n_var", *_STATS, "errors"))


@query(f"with {_FIRST} " + _apart_sql("select regexp_replace(v.chr, '^chr', '') as chr, v.position, v.ref, v.alt, f.info.cadd_phred as cadd from (select * from variants " + _WHERE + ") v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt", "cadd"))
def annot_vcf_file(spark, d):
    """The variants of a variant call file, named by its path."""
    ship(spark)
    out = _folder(spark, "given") + ".vcf"
    vcf.write(_plain(spark, d), out, {})
    return _apart(lookup.annotate(out, _source(spark, d), {"cadd": "cadd_phred"}, ordered=False).drop("_row"), "cadd")


@query(f"select distinct load_id as file_idx, v.variant_idx, regexp_replace(v.chr, '^chr', '') as chr, v.position, v.ref, v.alt, id from variants v join (select regexp_replace(chr, '^chr', '') as c, position as p, position + length(ref) - 1 as e from variants {_WHERE}) w on w.c = regexp_replace(v.chr, '^chr', '') and v.position between w.p and w.e")
def annot_vcf_ranges(spark, d):
    """All that lies on the reference bases of the variants of a file."""
    ship(spark)
    out = _folder(spark, "given") + ".vcf"
    vcf.write(_plain(spark, d), out, {})
    return lookup.annotate_vcf(_source(spark, d), out, [":id"])


@query(f"select variant_idx as vid, row_number() over (order by case when variant_idx % 40 = 0 then 0 when variant_idx % 40 > 5 then 1 else 2 end, variant_idx) as variant_idx from variants {_WHERE}")
def vcf_row_numbers(spark, d):
    """Three files of a folder, the largest one in the middle: rows are numbered in the order of the files."""
    out = _folder(spark, "three")
    k = F.col("variant_idx") % 40
    line = F.concat_ws("\t", "chr", "position", F.concat(F.lit("v"), "variant_idx"), "ref", "alt", F.lit("."), F.lit("."), F.lit("."))
    rows = _plain(spark, d).select(F.when(k == 0, 0).when(k > 5, 1).otherwise(2).alias("part"), F.col("variant_idx").alias("k"), line.alias("value"))
    heads = spark.createDataFrame([(p, i - 2, t) for p in range(3) for i, t in enumerate(("##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"))], "part int, k long, value string")
    heads.unionByName(rows).repartition(3, "part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(out)
    return vcf.import_plain(spark, out).select(F.substring("id", 2, 20).cast("bigint").alias("vid"), "variant_idx")


@query("select variant_idx as vid, coalesce(info.variant_type, '') || ';x=1' as gene_detail, case when isfinite(info.cadd_phred) then info.cadd_phred end as cadd from variants")
def import_annovar(spark, d):
    """Every variant, whatever its type holds: values are escaped for INFO and decoded by the importer."""
    return _annovar(spark, read(spark, d, "variants"), A.encode_hex(F.concat(F.coalesce("info.variant_type", F.lit("")), F.lit(";x=1"))))


@query(f"select variant_idx as vid, true as only_scores from variants {_WHERE}")
def import_annovar_scores(spark, d):
    """Without the fields of gene models."""
    v = _plain(spark, d)
    ship(spark)
    out = _folder(spark, "annovar")
    infos = {"VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number")} | {n: (F.lit("x"), ".", "String", n) for n in ("Func.refGene", "Gene.refGene", "ExonicFunc.refGene", "AAChange.refGene")} | {"AF": (F.lit("0.5"), ".", "String", "AF")}
    vcf.write(v, out, infos)
    got = vcf.import_annovar(spark, out, keep=False)
    return got.select(F.col("info.VIDS").cast("bigint").alias("vid"), (F.lit(got.schema["info"].dataType.simpleString() == "struct<VIDS:string,AF:float>") & (F.col("info.AF") == 0.5)).alias("only_scores"))


def _annovar(spark: SparkSession, v: DataFrame, detail: Column) -> DataFrame:
    """Variants written with a gene detail and a score, and imported."""
    ship(spark)
    out = _folder(spark, "annovar")
    number = F.when((F.abs("info.cadd_phred") < float("inf")) & ~F.isnan("info.cadd_phred"), F.col("info.cadd_phred"))
    infos = {
        "ANNOVAR_DATE": (F.lit("2020"), "1", "String", "begin"), "VIDS": (F.col("variant_idx").cast("string"), "1", "String", "number"),
        "GeneDetail.refGene": (detail, ".", "String", "detail"),
        "CADD_phred": (number, ".", "String", "score"), "ALLELE_END": (F.lit(True), "0", "Flag", "end"),
    }
    vcf.write(v, out, infos)
    got = vcf.import_annovar(spark, out)
    assert "ANNOVAR_DATE" not in got.schema["info"].dataType.names
    return got.select(F.col("info.VIDS").cast("bigint").alias("vid"), F.col("info.`GeneDetail.refGene`").alias("gene_detail"), F.col("info.CADD_phred").alias("cadd"))


_CSV = "select chr, position, ref, alt, ref || ',' || alt as allele, {id} as id, {filter} as filter, case when isfinite(info.cadd_phred) then info.cadd_phred end as cadd from variants " + _WHERE


def _csv(spark: SparkSession, d: str) -> DataFrame:
    v = _plain(spark, d)
    number = F.when((F.abs("info.cadd_phred") < float("inf")) & ~F.isnan("info.cadd_phred"), F.col("info.cadd_phred"))
    key = F.concat_ws("-", "chr", "position", "ref", "alt")
    return v.select(key.alias("variant_vcf"), F.col("chr").alias("chromosome"), "position", F.col("ref").alias("ref_vcf"), F.col("alt").alias("alt_vcf"), F.concat(F.lit("rs"), "variant_idx").alias("rsid"), number.alias("cadd_phred"))


_TYPES = {"cadd_phred": "numeric", "rsid": "character"}


@query(_CSV.format(id="concat_ws('-', chr, position, ref, alt)", filter="'PASS'"))
def import_favor_csv(spark, d):
    out = _folder(spark, "csv")
    _csv(spark, d).write.option("header", True).option("escape", '"').csv(out)
    got = favor.read_csv(spark, [out], _TYPES)
    return got.select("chr", "position", "ref", "alt", "allele", "id", "filter", F.col("info.FAVOR.cadd_phred").alias("cadd"))


@query(_CSV.format(id="'rs' || variant_idx", filter="null::varchar").replace("select chr", "select row_number() over (order by variant_idx) as variant_idx, chr", 1))
def import_favor_tar(spark, d):
    """An archive whose members lie out of order; it is packed here as a stream on shared storage."""
    folder = _folder(spark, "tar")
    _csv(spark, d).orderBy(F.substring("rsid", 3, 20).cast("bigint")).write.option("header", True).option("escape", '"').csv(folder)
    fs, path = file_system(folder)
    names = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(".csv"))
    with fs.open_output_stream(path + "/all.tar.gz", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
        for i in reversed(range(len(names))):
            member = tarfile.TarInfo(f"chr_{i + 1}.csv")
            member.size = fs.get_file_info(names[i]).size
            with fs.open_input_stream(names[i]) as source:
                tar.addfile(member, source)
    got = favor.read_tar(spark, folder + "/all.tar.gz")
    return got.select("variant_idx", "chr", "position", "ref", "alt", "allele", "id", "filter", F.col("info.cadd_phred").alias("cadd"))


@query("select variant_idx, chr, position, ref, alt from variants")
def table_roundtrip(spark, d):
    """Written by chromosome, read again with a schema of its own (a chromosome is text, whatever the folder is called)."""
    out = _folder(spark, "table")
    v = read(spark, d, "variants").select("variant_idx", "position", "ref", "alt", "chr")
    tables.write_table(v, out, "gzip")
    return spark.read.schema(v.schema).parquet(out).select("variant_idx", "chr", "position", "ref", "alt")


_INFO = ("variant_type", "allele_type", "was_mixed", "cadd_phred", "linsight", "apc_conservation", "apc_epigenetics", "CSQ", "ANN")


_SCORES = ("qual", "cadd_phred", "linsight", "apc_conservation", "apc_epigenetics")


@query(_apart_sql("select * exclude (info), " + ", ".join(f"info.{c} as {c}" for c in _INFO) + " from variants", *_SCORES))
def tsv_roundtrip(spark, d):
    """Every variant with every leaf column, written as flat text and read again."""
    out = _folder(spark, "tsv")
    v = read(spark, d, "variants")
    tables.write_tsv(v, out, "gzip")
    got = tables.read_tsv(spark, out, v.schema)
    return _apart(got.withColumnsRenamed({c: c.removeprefix("info.") for c in got.columns}), *_SCORES)


_DIGESTED = ("chr", "position", "ref", "alt", "id", "filter")


@query(" union all ".join(f"select '{c}' as column_name, sum(('0x' || substr(md5(variant_idx || '|' || coalesce('=' || {c}, '')), 1, 8))::bigint)::bigint as digest from variants" for c in _DIGESTED))
def table_digests(spark, d):
    return tables.digests(read(spark, d, "variants").select("variant_idx", *_DIGESTED))


@query("select category, n from (" + _COUNTERS["impact"] + ")")
def stream_counters(spark, d):
    """Records arrive as files; each batch leaves its counters, and the sum is the counter of all."""
    out = _folder(spark, "stream")
    source = read(spark, d, "records")
    path = f"{d}/records.parquet"
    if os.path.isfile(path):  # a stream reads folders
        path = out + "-in"
        source.write.parquet(path)
    q = counters.run(spark.readStream.schema(source.schema).parquet(path), stats.record_pairs(), out, out + "-at")
    q.awaitTermination()
    return counters.total(spark, out).where("stat = 'impact'").select("category", "n")


_REPORTED = _COUNTERS | {"qual": f"select {_QUAL} as category, count(*) as n from variants where qual is not null and not isnan(qual) group by 1"}
_SPAN = "select sum(s) as span from (select max(position) - min(position) + 1 as s from variants where chr is not null group by chr having count(position) > 0)"


@query(
    " union all ".join(f"select '{title}' as title, category, n::varchar as value from ({_REPORTED[name]})" for title, name, _ in report.SECTIONS)
    + """ union all (select 'Genes with most records', gene, n::varchar from (select gene, count(*) as n from records where gene <> '' group by gene order by n desc, gene limit 20))
union all select 'General information', 'Source', 'variants'
union all select 'General information', 'Variants', format('{:,}', count(*)) from variants
union all select 'General information', 'Annotation records', format('{:,}', count(*)) from records
union all select 'General information', 'Genes', format('{:,}', count(distinct gene)) from records where gene <> ''
union all select 'General information', 'Features', format('{:,}', count(distinct feature)) from records where feature <> ''"""
    + f" union all select 'General information', 'Span', format('{{:,}}', span::bigint) from ({_SPAN}) union all select 'General information', 'Bases per variant', format('{{:,.2f}}', span / (select count(*) from variants)) from ({_SPAN})"
)
def report_sections(spark, d):
    """The content of a report, row by row."""
    v = read(spark, d, "variants")
    got = report.collect(stats.counters(v, read(spark, d, "records")), "variants", ranges=stats.position_ranges(v))
    rows = [(s["title"], str(k), str(n)) for s in report.sections(got) for k, n in s.get("pairs", s.get("rows", [])) if k != "Generated"]
    return spark.createDataFrame(rows, "title string, category string, value string")


# ---- tables and files


@query("select case when load_id <= 3 then 0 when load_id <= 5 then 1 else 2 end as file_idx, chr, count(*) as n from variants where load_id is not null group by all")
def open_files(spark, d):
    """Three tables opened as one; the order of the list is the number of the file."""
    out, v = _folder(spark, "open"), read(spark, d, "variants")
    parts = [v.where(c) for c in ("load_id <= 3", "load_id > 3 and load_id <= 5", "load_id > 5")]
    for i, p in enumerate(parts):
        p.write.parquet(f"{out}/{i}")
    return tables.open_tables(spark, [f"{out}/{i}" for i in range(3)]).groupBy("file_idx", "chr").agg(F.count(F.lit(1)).alias("n"))


@query("select unnest(['no list', 'given twice', 'not there', 'no variants', 'several chromosomes']) as input, true as rejected")
def open_checks(spark, d):
    """Inputs that are not opened."""
    path = f"{d}/variants.parquet"
    bad = {"no list": ([], False), "given twice": ([path, path], False), "not there": ([path + "-not"], False), "no variants": ([f"{d}/records.parquet"], False), "several chromosomes": ([path], True)}

    def rejected(paths: list[str], one: bool) -> bool:
        try:
            tables.open_tables(spark, paths, one)
        except (ValueError, FileNotFoundError):
            return True
        return False

    return spark.createDataFrame([(k, rejected(*v)) for k, v in bad.items()], "input string, rejected boolean")


@query("select unnest(['variant_idx', 'chr', 'position', 'ref', 'alt', 'allele', 'id', 'qual', 'filter', 'info']) as name, unnest(['bigint', 'string', 'int', 'string', 'string', 'string', 'string', 'float', 'string', 'struct<score:float>']) as type, 0::bigint as n_rows")
def empty_skeleton(spark, d):
    """A table without rows, written and read again."""
    out = _folder(spark, "empty")
    tables.write_table(tables.empty_table(spark, "score: float"), out, partition=False)
    got = spark.read.parquet(out)
    return spark.createDataFrame([(n, t, got.count()) for n, t in got.dtypes], "name string, type string, n_rows bigint")


@query("select unnest(['zstd', 'gzip', 'snappy', 'none']) as codec, count(*) as n, sum(position)::bigint as positions from variants")
def table_codecs(spark, d):
    v, out = read(spark, d, "variants").select("variant_idx", "chr", "position"), _folder(spark, "codec")
    parts = None
    for c in tables.CODECS:
        tables.write_table(v, f"{out}-{c}", c)
        one = spark.read.schema(v.schema).parquet(f"{out}-{c}").agg(F.lit(c).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("select unnest(['consequence', 'impact', 'gene', 'feature']) as slot, unnest(['Consequence', 'IMPACT', 'SYMBOL', 'Feature']) as field, 'CSQ' as root union all select unnest(['consequence', 'gene', 'errors']), unnest(['Annotation', 'Gene_Name', 'ERRORS-WARNINGS-INFO']), 'ANN'")
def annotator_slots(spark, d):
    """Which annotator's records a table holds, and where it keeps what."""
    from strandloom.operators import catalog

    names = lambda xs: ", ".join(f"`{x}`: string" for x in xs)
    vep = spark.createDataFrame([], f"variant_idx bigint, CSQ struct<list: array<struct<{names(['Allele', 'Consequence', 'IMPACT', 'SYMBOL', 'Feature'])}>>>, ANN string")
    snpeff = spark.createDataFrame([], f"variant_idx bigint, ANN array<struct<{names(['Allele', 'Annotation', 'Gene_Name', 'ERRORS-WARNINGS-INFO'])}>>")
    rows = [(s, f, root) for root, slots in map(catalog.profile, (vep, snpeff)) for s, f in slots.items()]
    return spark.createDataFrame(rows, "slot string, field string, root string")


@query("select biotype, filter, count(*) as n from records join variants using (variant_idx) group by all")
def value_counts_scalar_and_list(spark, d):
    """A field with one value per variant against one with several."""
    from strandloom.operators import counts

    lists = read(spark, d, "records").groupBy("variant_idx").agg(F.collect_list(F.struct("biotype")).alias("rs"))
    df = read(spark, d, "variants").join(lists, "variant_idx")
    return counts.value_counts(counts.per_record(df, ["filter"], ["rs.biotype"]).withColumnRenamed("rs_biotype", "biotype"), {"biotype": F.col("biotype"), "filter": F.col("filter")})


@query("select coalesce(gene, 'none') as gene, count(*) as n from records group by 1")
def value_counts_blocks(spark, d):
    """Counts by a function of blocks of rows."""
    from strandloom.operators import counts

    return counts.value_counts_blocks(read(spark, d, "records").select("gene"), lambda b: b.fillna("none").groupby("gene").size().reset_index(name="n"), "gene string, n long")


@query("select unnest(['fileformat', 'reference', 'reference', 'missing']) as id, unnest(['VCFv4.2', 'first', 'first', '']) as value, unnest([1, 2, 3, 4]) as place")
def header_lookup(spark, d):
    """Meta lines by name: the first one counts."""
    ship(spark)
    out = _folder(spark, "head") + ".vcf"
    vcf.write(_plain(spark, d), out, {}, meta=[("reference", "first"), ("reference", "second")])
    head = vcf.read_header(spark, out)
    return spark.createDataFrame([(k, head.get(k) or "", i) for i, k in enumerate(("fileformat", "reference", "reference", "missing"), 1)], "id string, value string, place int")


@query("select format, title, true as present from (select unnest(['html', 'markdown', 'rmarkdown', 'json']) as format), (select unnest([" + ", ".join(repr(t) for t in ("General information", *[s[0] for s in report.SECTIONS], "Genes with most records")) + "]) as title)")
def report_formats(spark, d):
    """A report in every format, by the ending of its file: whether each section is in it."""
    import tempfile

    v = read(spark, d, "variants")
    got = report.collect(stats.counters(v, read(spark, d, "records")), "variants", ranges=stats.position_ranges(v))
    titles = ["General information", *[s[0] for s in report.SECTIONS], "Genes with most records"]
    marks = {"html": "<h2>{}</h2>", "markdown": "## {}\n", "rmarkdown": "## {}\n", "json": '"title": "{}"'}
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # a report is a file of the driver's
        for kind, ending in (("html", "htm"), ("markdown", "MD"), ("rmarkdown", "Rmd"), ("json", "json")):
            with open(report.write_report(got, f"{folder}/a.{ending}")) as file:
                text = file.read()
            rows += [(kind, t, marks[kind].format(t) in text) for t in titles]
    return spark.createDataFrame(rows, "format string, title string, present boolean")


@query("select format('AnnotStat(variants: {:,} variants, {} counters)', count(*), 10) as shown from variants")
def report_shown(spark, d):
    """The line that stands for statistics, without the time."""
    got = report.collect(stats.counters(variants=read(spark, d, "variants")), "variants")
    return spark.createDataFrame([(repr(got).split(", created")[0] + ")",)], "shown string")


@query("select 'n_var' as stat, 'n' as category, count(*) as n from variants union all select 'qual', category, n from (" + _REPORTED["qual"] + ")" + "".join(f" union all select '{k}', category, n from ({_COUNTERS[k]})" for k in _OF_VARIANTS) + f" union all select 'span', 'n', span::bigint from ({_SPAN})")
def stat_merge_whole(spark, d):
    """Statistics of two halves of the loads, each collected by itself, merged with their ranges."""
    v = read(spark, d, "variants")
    half = F.coalesce(F.col("load_id"), F.lit(0)) <= 3
    a, b = (report.collect(stats.counters(variants=p), n, ranges=stats.position_ranges(p)) for n, p in (("a", v.where(half)), ("b", v.where(~half))))
    got = a.merge(b)
    return spark.createDataFrame([(s, k, n) for s, c in got.counts.items() for k, n in c.items()] + [("span", "n", got.span)], "stat string, category string, n bigint")
