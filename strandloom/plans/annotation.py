"""Queries of the annotation operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.dictionaries import SO_TERMS
from strandloom.functions import annotation as A
from strandloom.operators import catalog, counts, lookup, packed, stats
from strandloom.plans.training import packed_sql
from strandloom.session import checkpoint_dir, read
from strandloom.sources import vcf

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "variants")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "records")


def _source(spark: SparkSession, d: str) -> DataFrame:
    """The table of variants as an annotation source of several files, one a load."""
    return _variants(spark, d).withColumn("file_idx", F.col("load_id"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys to look up: those of all variants, and those at the head of all raw lines (mostly misses)."""
    own = _variants(spark, d).select(F.col("variant_idx").alias("_row"), A.make_key("chr", "position", "ref", "alt").alias("key"))
    lines = read(spark, d, "conversionfavor").select((F.col("line_id") + 1_000_000_000_000).alias("_row"), F.split_part("raw", F.lit(","), F.lit(1)).alias("key"))
    return own.unionByName(lines)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    # the generator keeps the key from being parsed again for every part of it
    parsed = _keys(spark, d).select("_row", F.explode(F.array(A.parse_key(F.col("key"), strict=False))).alias("k"))
    return parsed.where("k is not null").select("_row", "k.*")


def _apart(df: DataFrame, *names: str) -> DataFrame:
    """Scores that are no number, which is equal to nothing, as null, with a column that tells them from missing ones."""
    return df.withColumns({f"{n}_nan": F.coalesce(F.isnan(n), F.lit(False)) for n in names} | {n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _apart_sql(sql: str, *names: str) -> str:
    cols = ", ".join(f"coalesce(isnan({n}), false) as {n}_nan, case when not isnan({n}) then {n} end as {n}" for n in names)
    return f"select * exclude ({', '.join(names)}), {cols} from ({sql})"


_CHR = "regexp_replace(chr, '^chr', '')"
_KEYSQL = rf"""keys as (select _row, regexp_replace(p[1], '^chr', '') as chr, try_cast(case when regexp_full_match(p[2], '\s*[+-]?[0-9]+\s*') then p[2] end as integer) as position, p[3] as ref, p[4] as alt
  from (select _row, regexp_split_to_array(regexp_replace(key, '[-_:]$', ''), '[-_:]') as p from (
    select variant_idx as _row, concat_ws('-', chr, position, ref, alt) as key from variants
    union all select line_id + 1000000000000, string_split(raw, ',')[1] from conversionfavor)) where len(p) = 4 and try_cast(case when regexp_full_match(p[2], '\s*[+-]?[0-9]+\s*') then p[2] end as integer) is not null)"""
_FIRST = f"""first as (select * from (select {_CHR} as c, position as p, ref as r, alt as a, variant_idx, load_id as file_idx, info, id, row_number() over (partition by {_CHR}, position, ref, alt order by load_id, variant_idx) as k
  from variants) where k = 1)"""
_JOIN = "from keys left join first on c = chr and p = position and r = ref and a = alt"


@query(_apart_sql(f"with {_KEYSQL}, {_FIRST} select _row, chr, position, ref, alt, info.cadd_phred as cadd_phred, info.linsight as linsight, id {_JOIN}", "cadd_phred", "linsight"))
def annot_key_left(spark, d):
    return _apart(lookup.annotate_rows(_parsed(spark, d), _source(spark, d), ["cadd_phred", "linsight", ":id"]), "cadd_phred", "linsight")


@query(_apart_sql(f"with {_FIRST} select variant_idx0 as _row, chr, position, ref, alt, info.cadd_phred as cadd_phred from (select variant_idx as variant_idx0, {_CHR} as chr, position, ref, alt from variants) left join first on c = chr and p = position and r = ref and a = alt", "cadd_phred"))
def annot_key_df(spark, d):
    v = _variants(spark, d).withColumnRenamed("position", "pos")
    return _apart(lookup.annotate(v, _source(spark, d), ["cadd_phred"], row="variant_idx", ordered=False), "cadd_phred")


@query(f"with {_KEYSQL}, {_FIRST}, last as (select {_CHR} as lc, max(load_id) as m from variants group by 1) select _row, chr, position, ref, alt, variant_idx, coalesce(file_idx, m) as file_idx {_JOIN} left join last on lc = chr")
def annot_index_only(spark, d):
    return lookup.annotate_rows(_parsed(spark, d), _source(spark, d), [])


@query(f"with {_FIRST} select c as chr, p as position, r as ref, a as alt, file_idx, variant_idx from first")
def annot_first_file_wins(spark, d):
    return lookup.first_of_key(_source(spark, d), [F.lit(1)]).select(*lookup.KEY, "_at.*").select(*lookup.KEY, "file_idx", "variant_idx")


@query(_apart_sql(f"with {_KEYSQL}, {_FIRST} select _row, chr, position, ref, alt, info.cadd_phred as score, info.apc_conservation as cons {_JOIN}", "score", "cons"))
def annot_alias(spark, d):
    return _apart(lookup.annotate_rows(_parsed(spark, d), _source(spark, d), {"score": "cadd_phred", "cons": "info/apc_conservation"}), "score", "cons")


@query(_apart_sql(f"with {_KEYSQL}, {_FIRST}, s as (select f.*, v.allele, v.qual, v.filter, v.position as pos2, v.chr as chr2 from first f join variants v using (variant_idx)) select _row, keys.chr, keys.position, keys.ref, keys.alt, chr2 as ann_chr, pos2 as ann_pos, allele, id, qual, filter from keys left join s on c = keys.chr and p = keys.position and r = keys.ref and a = keys.alt", "qual"))
def annot_special_fields(spark, d):
    return _apart(lookup.annotate_rows(_parsed(spark, d), _source(spark, d), {"ann_chr": ":chromosome", "ann_pos": ":position", "allele": ":allele", "id": ":id", "qual": ":qual", "filter": ":filter"}), "qual")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range around every raw line whose key can be read."""
    k = _parsed(spark, d).where("_row > 1000000000000")
    return k.select("chr", (F.col("position") - 20000).alias("start"), (F.col("position") + 20000).alias("end"))


_RANGES = f"{_KEYSQL}, rg as (select chr as rc, position - 20000 as s, position + 20000 as e from keys where _row > 1000000000000)"


@query(f"with {_RANGES} select variant_idx, load_id, chr, position from variants where exists (select 1 from rg where rc = {_CHR} and variants.position between s and e)")
def annot_range_semi(spark, d):
    return lookup.in_ranges(_variants(spark, d), _ranges(spark, d)).select("variant_idx", "load_id", "chr", "position")


@query(f"with {_RANGES} select variant_idx, position from variants where {_CHR} = '7' and exists (select 1 from rg where variants.position between s and e)")
def annot_range_single_chr(spark, d):
    return lookup.in_ranges(_variants(spark, d), _ranges(spark, d), "7").select("variant_idx", "position")


@query(_apart_sql(f"with {_FIRST} select v.variant_idx, f.info.cadd_phred as cadd_phred, f.info.linsight as linsight from variants v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt", "cadd_phred", "linsight"))
def annot_write_roundtrip(spark, d):
    """Annotations written beside the variants and read again."""
    out = os.path.join(checkpoint_dir(spark), f"annotated-{abs(hash(d))}-{spark.sparkContext.applicationId}")
    v = _variants(spark, d).select("variant_idx", "chr", "position", "ref", "alt")
    lookup.add_annotations(v, _source(spark, d), ["cadd_phred", "linsight"], root="found").write.mode("overwrite").parquet(out)
    return _apart(spark.read.parquet(out).select("variant_idx", "found.cadd_phred", "found.linsight"), "cadd_phred", "linsight")


_TYPES = {"VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float", "DOUBLE": "double", "INTEGER": "int", "BIGINT": "bigint"}
_TYPE_OF = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in _TYPES.items()) + " end"


@query(f"""with t as (select typeof(info) as s from variants limit 1), x as (select unnest(regexp_extract_all(s, '("?[A-Za-z_0-9]+"?) ([A-Z]+)[,)]', 1)) as n, unnest(regexp_extract_all(s, '("?[A-Za-z_0-9]+"?) ([A-Z]+)[,)]', 2)) as t from t)
select replace(n, '"', '') as name, {_TYPE_OF} as type, 'vector' as trait, null::varchar as description from x""")
def annot_list(spark, d):
    return catalog.annotation_list(_variants(spark, d))


@query(f"with {_FIRST}, got as (select v.variant_idx as _row, regexp_replace(v.chr, '^chr', '') as chr, v.position, v.ref, v.alt, f.info as i from variants v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt) " + _apart_sql("select _row, chr, position, ref, alt, i.variant_type, i.allele_type, i.was_mixed, i.cadd_phred, i.linsight, i.apc_conservation, i.apc_epigenetics, i.CSQ, i.ANN from got", "cadd_phred", "linsight", "apc_conservation", "apc_epigenetics"))
def annot_all_fields(spark, d):
    """No fields named: all leaves of info."""
    got = lookup.annotate(_variants(spark, d).withColumnRenamed("position", "pos"), _source(spark, d), row="variant_idx", ordered=False)
    return _apart(got, "cadd_phred", "linsight", "apc_conservation", "apc_epigenetics")


@query(f"with {_FIRST} select row_number() over (order by v.variant_idx) as place, v.variant_idx as _row, f.variant_idx from variants v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt where v.chr is not null")
def annot_order(spark, d):
    """Annotations come in the order of the keys: the place of each row among those that come."""
    v = _variants(spark, d).where("chr is not null").withColumnRenamed("position", "pos")
    got = lookup.annotate(v.repartition(7, "ref"), _source(spark, d), [], row="variant_idx")
    return vcf.numbered(got.select("_row", "variant_idx"), "place").select("place", "_row", "variant_idx")


@query(f"with {_FIRST} " + _apart_sql("select v.variant_idx as _row, f.info.cadd_phred as cadd_phred from variants v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt", "cadd_phred"))
def annot_table_file(spark, d):
    """The variants of a stored table, named by its path."""
    return _apart(lookup.annotate(f"{d}/variants.parquet", _source(spark, d), ["cadd_phred"], ordered=False).select("_row", "cadd_phred"), "cadd_phred")


@query("select variant_idx, load_id, chr, position from variants where variant_idx in (select variant_idx from records where impact = 'HIGH')")
def annot_by_index(spark, d):
    """Variants by a list of indices: those that have a record of high impact."""
    return lookup.by_index(_variants(spark, d), _records(spark, d).where("impact = 'HIGH'")).select("variant_idx", "load_id", "chr", "position")


@query(f"with {_RANGES}, sets as (select case when rc in ('1', '2', '3') then 0 else 1 end as range_set, * from rg) select distinct range_set, load_id as file_idx, variant_idx, {_CHR} as chr, variants.position, ref, alt, id from sets join variants on rc = {_CHR} and variants.position between s and e")
def annot_range_sets(spark, d):
    """Several sets of ranges at once: rows once per set."""
    r = _ranges(spark, d)
    first = F.col("chr").isin("1", "2", "3")
    return lookup.annotate_ranges(_source(spark, d), [r.where(first), r.where(~first)], [":id"])


@query(f"with {_FIRST} " + _apart_sql("select v.* exclude (info), f.info.cadd_phred as found_cadd from variants v left join first f on c = regexp_replace(v.chr, '^chr', '') and p = v.position and r = v.ref and a = v.alt", "found_cadd", "qual"))
def annot_in_place(spark, d):
    """A stored table that gets annotations in its place."""
    out = os.path.join(checkpoint_dir(spark), f"in-place-{uuid.uuid4().hex}")
    _variants(spark, d).write.parquet(out)
    lookup.write_annotated(out, _source(spark, d), {"found_cadd": "cadd_phred"}, drop=("info",))
    return _apart(spark.read.parquet(out), "found_cadd", "qual")


# ---- records and scalar functions


@query("with r as (select variant_idx, unnest(" + packed_sql("info.CSQ") + ").value as value from variants), p as (select variant_idx, string_split(value, '|') as x from r) select variant_idx, " + ", ".join(f"coalesce(x[{i}], '') as f{i}" for i in range(1, 10)) + ", array_to_string(x[10:], '|') as f10 from p")
def split_pipe_records(spark, d):
    """CSQ records as ten sub-fields each: short ones padded, the last one takes what is over."""
    rows = _variants(spark, d).select("variant_idx", F.explode(packed.values(F.col("info.CSQ"))).alias("rec"))
    return rows.select("variant_idx", *[F.get(A.pieces(F.col("rec"), 10), F.lit(i)).alias(f"f{i + 1}") for i in range(10)])


def _first_records(v: DataFrame) -> DataFrame:
    """Allele and impact of each variant's first CSQ record; null for a variant without records."""
    # the generator keeps the field from being parsed again for every part of it
    rows = v.select("variant_idx", F.explode(F.array(F.get(packed.values(F.col("info.CSQ")), F.lit(0)))).alias("r"))
    part = lambda i: F.when(F.col("r").isNotNull(), F.get(A.pieces(F.col("r"), 4), F.lit(i)))
    return rows.select("variant_idx", part(0).alias("allele"), part(2).alias("impact"))


@query("with r as (select variant_idx, (" + packed_sql("info.CSQ") + ")[1].value as value from variants) select variant_idx, case when value is not null then split_part(value, '|', 1) end as allele, case when value is not null then split_part(value, '|', 3) end as impact from r")
def split_uniform_first(spark, d):
    """A field with one value per variant is read from the first record, however the field is packed."""
    return _first_records(_variants(spark, d))


@query("select doc_id, replace(replace(author, 'e', '='), 'o', ';') as decoded from documents where author is not null")
def decode_hex(spark, d):
    """Escapes nested five levels deep."""
    hexed = F.replace(F.replace("author", F.lit("e"), F.lit("\\x5cx5cx5cx5cx3d")), F.lit("o"), F.lit("\\x3b"))
    return read(spark, d, "documents").where("author is not null").select("doc_id", A.decode_hex(hexed).alias("decoded"))


@query("select variant_idx, case when isfinite(info.cadd_phred) then info.cadd_phred end as cadd, case when isfinite(qual) then qual end as qual from variants")
def finite_scores(spark, d):
    return _variants(spark, d).select("variant_idx", A.finite_or_null(F.col("info.cadd_phred")).alias("cadd"), A.finite_or_null(F.col("qual")).alias("qual"))


@query(r"""select line_id, case when regexp_full_match(f, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') then try_cast(trim(f) as double) end as as_number,
  case when regexp_full_match(f, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*') then try_cast(trunc(try_cast(trim(f) as double)) as integer) end as as_integer from (select line_id, split_part(raw, ',', 7) as f from conversionfavor)""")
def typed_try_cast(spark, d):
    f = F.split_part("raw", F.lit(","), F.lit(7))
    return read(spark, d, "conversionfavor").select("line_id", A.number(f).alias("as_number"), A.whole(f).alias("as_integer"))


@query("select line_id, coalesce(split_part(raw, ',', 8) in ('1', 'T', 'TRUE', 'YES'), false) as as_logical from conversionfavor")
def vep_logical(spark, d):
    return read(spark, d, "conversionfavor").select("line_id", A.logical(F.split_part("raw", F.lit(","), F.lit(8))).alias("as_logical"))


@query(f"with {_KEYSQL} select * from keys")
def parse_variant_id(spark, d):
    return _parsed(spark, d)


# ---- counts


@query("select impact, count(*) as n from records group by all")
def value_counts_1d(spark, d):
    return counts.value_counts(_records(spark, d), {"impact": F.col("impact")})


@query("select impact, feature_type, count(*) as n from records group by all")
def value_counts_2d(spark, d):
    return counts.value_counts(_records(spark, d), {"impact": F.col("impact"), "feature_type": F.col("feature_type")})


@query("with c as (select impact, biotype, count(*) as n from records group by all) select x.impact, y.biotype, coalesce(c.n, 0)::bigint as n from (select distinct impact from c) x cross join (select distinct biotype from c) y left join c on c.impact is not distinct from x.impact and c.biotype is not distinct from y.biotype")
def value_counts_complete(spark, d):
    return counts.value_counts(_records(spark, d), {"impact": F.col("impact"), "biotype": F.col("biotype")}, complete=True)


@query("select gene, n, row_number() over (order by gene asc nulls last) as place from (select gene, count(*) as n from records group by gene)")
def value_counts_null_last(spark, d):
    got = counts.value_counts(_records(spark, d), {"gene": F.col("gene")})
    # sorted by range and numbered from the counts of the partitions: no task orders all values
    return vcf.numbered(got.orderBy(F.col("gene").asc_nulls_last()), "place").select("gene", "n", "place")


@query("select impact, count(*) as n from (select distinct variant_idx, impact from records) group by all")
def value_counts_per_variant(spark, d):
    return counts.value_counts(_records(spark, d), {"impact": F.col("impact")}, per_variant="variant_idx")


@query("select biotype, sum(n)::bigint as n from (select load_id, biotype, count(*) as n from records group by all) group by biotype")
def value_counts_multifile(spark, d):
    """Counts of single files added up."""
    per = counts.value_counts(_records(spark, d), {"load_id": F.col("load_id"), "biotype": F.col("biotype")})
    return per.groupBy("biotype").agg(F.sum("n").alias("n"))


@query("select case when polyphen is null or polyphen = '' then 'none' else regexp_replace(polyphen, '\\(.*$', '') end as value, count(*) as n from records group by all")
def value_counts_fun(spark, d):
    f = lambda c: F.when(c.isNull() | (c == ""), "none").otherwise(A.before_parenthesis(c))
    return counts.value_counts_by(_records(spark, d), f, ["polyphen"])


def _entries(spark, d):
    place = _variants(spark, d).select("variant_idx", "chr", "position", F.col("info.cadd_phred").alias("cadd"))
    return _records(spark, d).select("variant_idx", "gene", "impact", "biotype", "consequence").join(place, "variant_idx")


def _units(df):
    return df.withColumn("index", F.array_join("index", ",")).withColumnsRenamed({"start": "first_position", "end": "last_position"})


_ENTRIES = "e as (select variant_idx, gene, impact, biotype, consequence, chr, position, info.cadd_phred as cadd from records join variants using (variant_idx))"
_UNIT = "min_by(chr, variant_idx) as chr, min_by(position, variant_idx) as first_position, max_by(position, variant_idx) as last_position, array_to_string(list_sort(list(distinct variant_idx)), ',') as index"


@query(f"with {_ENTRIES} select gene, {_UNIT} from e where gene <> '' group by gene")
def unit_group_single(spark, d):
    return _units(counts.unit_groups(_entries(spark, d), ["gene"]))


@query(f"with {_ENTRIES} select gene, {_UNIT} from e where gene <> '' and coalesce(impact in ('HIGH', 'MODERATE'), false) group by gene")
def unit_group_cond_in(spark, d):
    return _units(counts.unit_groups(_entries(spark, d), ["gene"], {"impact": ["HIGH", "MODERATE"]}))


@query(f"with {_ENTRIES} select bin, {_UNIT} from (select *, case when cadd >= 10 then 'damaging' when cadd < 10 then 'tolerated' end as bin from e) where bin is not null and coalesce(biotype = 'protein_coding', true) group by bin")
def unit_group_cond_fn(spark, d):
    e = _entries(spark, d).withColumnRenamed("cadd", "bin")
    return _units(counts.unit_groups(e, ["bin"], {"bin": lambda c: F.when(c >= 10, "damaging").when(c < 10, "tolerated"), "biotype": lambda c: c == "protein_coding"}))


@query(f"with {_ENTRIES} select gene, impact, {_UNIT} from e where gene <> '' and impact <> '' group by gene, impact")
def unit_group_multi_key(spark, d):
    return _units(counts.unit_groups(_entries(spark, d), ["gene", "impact"]))


@query(f"with {_ENTRIES}, u as (select gene, {_UNIT}, min(variant_idx) as lowest from e where gene <> '' group by gene) select row_number() over (order by lowest, gene) as place, gene, index from u")
def unit_group_order(spark, d):
    """Groups in the order of their first index."""
    got = vcf.numbered(counts.unit_groups(_entries(spark, d), ["gene"], ordered=True), "place")
    return got.select("place", "gene", F.array_join("index", ",").alias("index"))


@query("select info.variant_type as variant_type, min_by(chr, variant_idx) as chr, min_by(position, variant_idx) as first_position, max_by(position, variant_idx) as last_position, array_to_string(list_sort(list(distinct variant_idx)), ',') as index from variants where info.variant_type <> '' group by 1")
def unit_group_info(spark, d):
    """Units by a field of info that has one value per variant."""
    return _units(counts.unit_groups(_variants(spark, d), ["info/variant_type"])).withColumnRenamed("info/variant_type", "variant_type")


@query(f"with {_ENTRIES} select gene, (variant_idx // 65536)::bigint as container, array_to_string(list_sort(list(distinct variant_idx)), ',') as index, count(distinct variant_idx) as n from e where gene <> '' group by all")
def unit_members(spark, d):
    """Units of any size: a row for each container of neighbouring indices."""
    got = counts.unit_members(_entries(spark, d), ["gene"])
    return got.select("gene", "container", F.array_join("index", ",").alias("index"), F.size("index").cast("bigint").alias("n"))


@query(f"with {_ENTRIES} select gene, count(distinct variant_idx) as n, min_by(chr, variant_idx) as chr, min_by(position, variant_idx) as first_position, max_by(position, variant_idx) as last_position from e where gene <> '' group by gene")
def unit_ranges(spark, d):
    got = counts.unit_ranges(counts.unit_members(_entries(spark, d), ["gene"]), ["gene"])
    return got.withColumnsRenamed({"start": "first_position", "end": "last_position"})


# ---- statistics: one counter each, then all of them in one pass

_SO = "so(term, rank, impact, class, region) as (values " + ", ".join(f"('{t[0]}', {i + 1}, '{t[1]}', {repr(t[2]) if t[2] else 'null'}, '{t[3]}')" for i, t in enumerate(SO_TERMS)) + ")"
_AL = "al as (select coalesce(ref, '') as r, unnest(string_split(coalesce(alt, ''), ',')) as a from variants)"
_CLASS = "case when a like '<%' or a = '*' or regexp_matches(a, '[^ACGTNacgtn]') then 'other' when length(r) < length(a) then 'insertion' when length(r) > length(a) then 'deletion' when length(r) > 1 then 'substitution (MNV)' else 'SNV' end"
_TERMS = "tm as (select variant_idx, unnest(string_split(consequence, '&')) as term from records where consequence is not null)"
_SEVERE = f"{_TERMS}, {_SO}, sv as (select variant_idx, min(rank) as rank from tm join so using (term) group by variant_idx)"
_QUAL = "case " + " ".join(f"when qual <= {b} then '{x}'" for b, x in zip(A.QUAL_BREAKS, A.qual_labels())) + f" else '{A.qual_labels()[-1]}' end"

_COUNTERS = {
    "chrom": "select chr as category, count(*) as n from variants where chr is not null group by 1",
    "n_allele": "select (len(string_split(coalesce(alt, ''), ',')) + 1)::varchar as category, count(*) as n from variants group by 1",
    "var_class": f"with {_AL} select {_CLASS} as category, count(*) as n from al group by 1",
    "base_change": f"with {_AL} select upper(r) || '>' || upper(a) as category, count(*) as n from al where {_CLASS} = 'SNV' group by 1",
    "indel_len": f"with {_AL} select greatest(least(length(a) - length(r), 21), -21)::varchar as category, count(*) as n from al where {_CLASS} in ('insertion', 'deletion') group by 1",
    "known": "select case when id is not null and id not in ('', '.') then 'known' else 'novel' end as category, count(*) as n from variants group by 1",
    "qual_na": "select 'NA' as category, count(*) as n from variants where qual is null or isnan(qual) having count(*) > 0",
    "filter": "select filter as category, count(*) as n from variants where filter is not null group by 1",
    "n_annot": "select 'n' as category, count(*) as n from records having count(*) > 0",
    "cons_all": f"with {_TERMS} select term as category, count(*) as n from tm group by 1",
    "region": f"with {_TERMS}, {_SO} select region as category, count(*) as n from tm join so using (term) group by 1",
    "func_class": f"with {_TERMS}, {_SO} select class as category, count(*) as n from tm join so using (term) where class is not null group by 1",
    "cons_severe": f"with {_SEVERE} select term as category, count(*) as n from sv join so using (rank) group by 1",
    "impact_severe": f"with {_SEVERE} select impact as category, count(*) as n from sv join so using (rank) group by 1",
    "impact": "select impact as category, count(*) as n from records where impact <> '' group by 1",
    "biotype": "select biotype as category, count(*) as n from records where biotype <> '' group by 1",
    "feature_type": "select feature_type as category, count(*) as n from records where feature_type <> '' group by 1",
    "feature": "select feature as category, count(*) as n from records where feature <> '' group by 1",
    "sift": "select regexp_replace(sift, '\\(.*$', '') as category, count(*) as n from records where sift <> '' group by 1",
    "polyphen": "select regexp_replace(polyphen, '\\(.*$', '') as category, count(*) as n from records where polyphen <> '' group by 1",
    "errors": "select unnest(string_split(errors, '&')) as category, count(*) as n from records where errors <> '' group by 1",
    "gene_impact": "select gene || chr(13) || coalesce(impact, '') as category, count(*) as n from records where gene <> '' group by 1",
}
_OF_VARIANTS = ("chrom", "n_allele", "var_class", "base_change", "indel_len", "known", "qual_na", "filter")


def _counter(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        if name in _OF_VARIANTS:
            got = stats.counters(variants=_variants(spark, d), only={name})
        else:
            got = stats.counters(records=_records(spark, d), only={name})
        return got.where(F.col("stat") == name).select("category", "n")

    run.__name__ = f"stat_{name}"
    run.__doc__ = f"The counter {name}."
    return run


for _name, _sql in _COUNTERS.items():
    query(_sql)(_counter(_name))


def _counters(spark, d):
    return stats.counters(_variants(spark, d), _records(spark, d))


@query("select chr, min(position) as pos_min, max(position) as pos_max from variants where chr is not null group by chr")
def stat_pos_range(spark, d):
    return stats.position_ranges(_variants(spark, d))


@query(f"with b as (select (unnest(generate_series(0, {len(A.qual_labels()) - 1})))::int as bin, unnest({A.qual_labels()}) as category), h as (select {_QUAL} as category, count(*) as n from variants where qual is not null and not isnan(qual) group by 1) select bin, category, coalesce(n, 0)::bigint as n from b left join h using (category)")
def stat_qual_hist(spark, d):
    return stats.histogram(stats.counters(variants=_variants(spark, d), only={"qual"}))


@query("select 'n_var' as stat, 'n' as category, count(*) as n from variants having count(*) > 0 union all select 'qual', " + _QUAL + ", count(*) from variants where qual is not null and not isnan(qual) group by all" + "".join(f" union all select '{k}' as stat, category, n from ({s})" for k, s in _COUNTERS.items()))
def stat_all_one_pass(spark, d):
    return _counters(spark, d)


@query("select stat, category, sum(n)::bigint as n from (select load_id, 'known' as stat, case when id is not null and id not in ('', '.') then 'known' else 'novel' end as category, count(*) as n from variants group by all) group by all")
def stat_merge(spark, d):
    """Counters of two halves of the loads, merged."""
    v = _variants(spark, d)
    half = F.coalesce(F.col("load_id"), F.lit(0)) <= 3
    return stats.merge(stats.counters(variants=v.where(half)), stats.counters(variants=v.where(~half))).where("stat = 'known'")


@query("select chr, min(position) as pos_min, max(position) as pos_max from variants where chr is not null group by chr")
def stat_merge_ranges(spark, d):
    """Ranges of chromosomes of two halves of the loads, merged."""
    v = _variants(spark, d)
    half = F.coalesce(F.col("load_id"), F.lit(0)) <= 3
    return stats.merge_ranges(stats.position_ranges(v.where(half)), stats.position_ranges(v.where(~half)))


_GENES = "select gene, count(*) as total, count(*) filter (impact = 'HIGH') as HIGH, count(*) filter (impact = 'MODERATE') as MODERATE, count(*) filter (impact = 'LOW') as LOW, count(*) filter (impact = 'MODIFIER') as MODIFIER, count(*) filter (coalesce(impact, '') not in ('', 'HIGH', 'MODERATE', 'LOW', 'MODIFIER')) as other, count(*) filter (coalesce(impact, '') = '') as unknown from records where gene <> '' group by gene"


@query(_GENES)
def gene_table(spark, d):
    return stats.gene_table(_records(spark, d)).orderBy(F.desc("total"), "gene")


@query(f"select gene, total from ({_GENES}) order by total desc, gene limit 20")
def top_genes(spark, d):
    return stats.gene_table(_records(spark, d)).select("gene", "total").orderBy(F.desc("total"), "gene").limit(20)


@query(f"with {_AL} select upper(r) as ref, " + ", ".join(f"count(*) filter (upper(a) = '{b}') as {b}" for b in "ACGT") + f" from al where {_CLASS} = 'SNV' and upper(r) in ('A', 'C', 'G', 'T') group by 1")
def base_matrix(spark, d):
    return stats.base_matrix(_variants(spark, d))


@query(f"with {_AL}, s as (select upper(r) || upper(a) as c from al where {_CLASS} = 'SNV' and upper(r) in ('A', 'C', 'G', 'T') and upper(a) in ('A', 'C', 'G', 'T') and upper(r) <> upper(a)) select count(*) filter (c in ('AG', 'GA', 'CT', 'TC')) as n_ts, count(*) filter (c not in ('AG', 'GA', 'CT', 'TC')) as n_tv, round(n_ts / n_tv, 6) as ratio from s")
def ts_tv(spark, d):
    return stats.ts_tv(stats.counters(variants=_variants(spark, d), only={"base_change"}))


@query(f"with {_TERMS}, {_SO} select count(*) filter (class = 'MISSENSE') as missense, count(*) filter (class = 'SILENT') as silent, round(missense / silent, 6) as ratio from tm join so using (term)")
def missense_silent(spark, d):
    return stats.missense_silent(stats.counters(records=_records(spark, d), only={"func_class"}))


@query("select sum(s)::bigint as span, sum(k)::bigint as n_variant, round(sum(s) / sum(k), 6) as rate from (select max(position) - min(position) + 1 as s, count(*) as k from variants where chr is not null group by chr)")
def variant_rate(spark, d):
    return stats.variant_rate(_variants(spark, d))


@query("select count(distinct gene) filter (gene <> '') as n_genes, count(distinct feature) filter (feature <> '') as n_features from records")
def n_genes_features(spark, d):
    got = stats.counters(records=_records(spark, d), only={"gene_impact", "feature"})
    gene = F.split_part("category", F.lit("\r"), F.lit(1))
    return got.where("stat in ('gene_impact', 'feature')").agg(F.countDistinct(F.when(F.col("stat") == "gene_impact", gene)).alias("n_genes"), F.count(F.when(F.col("stat") == "feature", 1)).alias("n_features"))


@query(f"select chr, n, row_number() over (order by try_cast({_CHR} as integer) asc nulls last, {_CHR}, chr) as place from (select chr, count(*) as n from variants where chr is not null group by chr)")
def chrom_order(spark, d):
    from pyspark.sql.window import Window

    got = _variants(spark, d).where("chr is not null").groupBy("chr").agg(F.count(F.lit(1)).alias("n"))
    return got.select("chr", "n", F.row_number().over(Window.orderBy(*A.chrom_order(F.col("chr")), "chr")).alias("place"))  # as many rows as chromosomes


@query(f"with {_AL}, i as (select greatest(least(length(a) - length(r), 21), -21) as len, count(*) as n from al where {_CLASS} in ('insertion', 'deletion') group by 1) select len::int as len, n from i order by len")
def indel_order(spark, d):
    got = stats.counters(variants=_variants(spark, d), only={"indel_len"})
    return got.select(F.col("category").cast("int").alias("len"), "n").orderBy("len")


@query("with c as (select 'impact' as stat, impact as category, count(*) as n from records where impact <> '' group by all union all select 'biotype', biotype, count(*) from records where biotype <> '' group by all) select stat, category, n, round(n * 100 / sum(n) over (partition by stat), 2) as percent from c")
def percent_of_total(spark, d):
    got = stats.counters(records=_records(spark, d), only={"impact", "biotype"})
    return stats.percent_of_total(got)
