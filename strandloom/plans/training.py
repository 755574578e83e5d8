"""Queries of the general data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import drift, packed, profile, rejects
from strandloom.session import checkpoint_dir, read, ship

PROFILED = {n: f"info.{n}" for n in ("cadd_phred", "linsight", "apc_conservation")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.change_log(read(spark, d, "favor_csv_header"), read(spark, d, "vep_output_format"))


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    """The union schema of all files and of all releases."""
    both = (("favor_csv_header", rejects.header_columns(read(spark, d, "favor_csv_header"))), ("vep_output_format", drift.release_columns(read(spark, d, "vep_output_format"))))
    out = [drift.union_schema(c).select(F.lit(n).alias("dictionary"), "column_name", "type", "n_files") for n, c in both]
    return out[0].unionByName(out[1])


def p1_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines that load, in one consistent set of columns."""
    return drift.consistent_lines(read(spark, d, "conversionfavor"), read(spark, d, "favor_csv_header"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """All CSQ records in one consistent set of columns."""
    v = read(spark, d, "variants").select("variant_idx", F.col("vep_release").alias("release"), F.posexplode(packed.values(F.col("info.CSQ"))).alias("i", "value"))
    rows = v.select("variant_idx", "release", (F.col("i") + 1).alias("pos"), "value")
    return drift.consistent_records(rows, read(spark, d, "vep_output_format"))


def _values(wide: DataFrame, keys: list[str]) -> DataFrame:
    """The filled cells of a wide table, a row each, by the type of their column."""
    kinds = {"string": "text", "double": "number", "bigint": "whole", "boolean": "flag"}
    types = {"text": "string", "number": "double", "whole": "bigint", "flag": "boolean"}

    def cell(name: str, kind: str):
        v = F.col(f"`{name}`")
        return F.struct(F.lit(name).alias("column_name"), *[(v if kinds[kind] == k else F.lit(None)).cast(t).alias(k) for k, t in types.items()])

    cells = F.explode(F.array(*[cell(n, t) for n, t in wide.dtypes if n not in keys])).alias("x")
    return wide.select(*keys, cells).select(*keys, "x.*").where("text is not null or number is not null or whole is not null or flag is not null")


def p1_line_values(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of lines, cell by cell."""
    return _values(p1_lines(spark, d), ["line_id", "file_id"])


def p1_record_values(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of records, cell by cell."""
    return _values(p1_records(spark, d), ["variant_idx", "pos", "release"])


def _packed(spark: SparkSession, d: str) -> DataFrame:
    variants = read(spark, d, "variants")
    records = packed.split_rows(variants, {"CSQ": F.col("info.CSQ"), "ANN": F.col("info.ANN")}, "variant_idx")
    terms = packed.split_rows(read(spark, d, "so_consequence"), {"Term": F.col("term")}, "so_id", packed.TERMS)
    return records.unionByName(terms)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("field", "row_id", "pos", "value")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    """How values were packed: quoted ones and ones with malformed quotes, by field."""
    return _packed(spark, d).groupBy("field", "quoted", "error").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    headers = read(spark, d, "favor_csv_header")
    lines = rejects.line_rejects(read(spark, d, "conversionfavor"), headers).select(F.lit("conversionfavor").alias("dictionary"), "row_id", "reason")
    return lines.unionByName(rejects.header_rejects(headers).select(F.lit("favor_csv_header").alias("dictionary"), "row_id", "reason"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The lines that load: identifier, file, number of fields."""
    return rejects.load_lines(read(spark, d, "conversionfavor"), read(spark, d, "favor_csv_header")).select("line_id", "file_id", F.size("fields").alias("n_fields"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return profile.issues(read(spark, d, "variants"), read(spark, d, "column_profile"), PROFILED)


def _by_load(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all loads, one of them not delivered and one the same within a load, in a table with files of one load each."""
    ship(spark)
    out = f"{checkpoint_dir(spark)}/by-load-{uuid.uuid4().hex}"
    info = F.struct(F.col("info.cadd_phred").alias("cadd_phred"), F.lit(None).cast("float").alias("linsight"), F.col("load_id").cast("float").alias("apc_conservation"))
    rows = read(spark, d, "variants").where("load_id is not null").select("load_id", info.alias("info"), F.col("load_id").alias("part"))
    rows.repartitionByRange(64, "load_id").write.partitionBy("part").parquet(out)
    return spark.read.parquet(out)


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Where the counts of such a table come from: the columns that are the same within a load are hardly read.  (Chunks of one or
    two rows have no dictionary, so those are.)"""
    got = profile.chunk_counts(_by_load(spark, d), PROFILED, "load_id").where("name <> 'cadd_phred'")
    scanned = F.sum(F.when(F.col("scanned"), F.col("n")).otherwise(0))
    return got.groupBy(F.col("name").alias("column_name")).agg(F.sum("n").alias("n_rows"), (scanned * 10 < F.sum("n")).alias("settled"))


def p4_by_load(spark: SparkSession, d: str) -> DataFrame:
    """The issues of such a table."""
    return profile.issues(_by_load(spark, d), read(spark, d, "column_profile"), PROFILED)


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changes from each load to the next."""
    ship(spark)
    got = profile.changes(profile.profile(read(spark, d, "variants"), PROFILED))
    return got.select("load_id", "column_name", "previous_load", *[F.round(c, 6).alias(c) for c in got.columns[3:]])


PATTERNS = {"chr": ("chr", "(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X|Y)"), "ref": ("ref", "[ACGTNacgtn]+"), "id": ("id", "rs[0-9]+"), "variant_type": ("info.variant_type", "[a-z]+")}


def p4_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Values of text columns that break their pattern, by load."""
    return profile.pattern_violations(read(spark, d, "variants"), PATTERNS)


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each load and column without its distribution, which p4_distribution has."""
    ship(spark)
    got = profile.profile(read(spark, d, "variants"), PROFILED)
    return got.select("load_id", "column_name", "n_rows", "n_null", "n_nan", "n_infinite", "n_distinct", "min_finite", "max_finite")


def p4_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each load and column with quartiles and the values out of the accepted range."""
    ship(spark)
    return profile.profile(read(spark, d, "variants"), PROFILED, accepted=read(spark, d, "column_profile"))


def p4_footers(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each column of the whole table, from footers and dictionaries."""
    ship(spark)
    return profile.footer_profile(read(spark, d, "variants"), PROFILED)


QUERIES = {f.__name__: f for f in (p1_found, p1_schema, p1_lines, p1_line_values, p1_records, p1_record_values, p2_found, p2_flags, p3_found, p3_loaded, p4_found, p4_profile, p4_distribution, p4_footers, p4_chunks, p4_by_load, p4_changes, p4_patterns)}

_VALUES = "select load_id, unnest(['cadd_phred', 'linsight', 'apc_conservation']) as column_name, unnest([info.cadd_phred, info.linsight, info.apc_conservation])::double as v from variants"
_SENSE = r"trim(regexp_replace(lower(coalesce(description, '')), '\s+', ' ', 'g'), ' .')"
_USABLE = r"""select file_id, ordinal, first(feed order by header_id) as feed, first(file_seq order by header_id) as file_seq, first(column_name order by header_id) as name,
  first(lower(trim(type)) order by header_id) as type, first(description order by header_id) as description, first(delivered_at order by header_id) as delivered_at
  from favor_csv_header where regexp_full_match(column_name, '[A-Za-z0-9_.]+') and lower(trim(type)) in ('logical', 'integer', 'numeric', 'character')
  and (length(concat_ws('', column_name, type, description)) - length(replace(concat_ws('', column_name, type, description), '"', ''))) % 2 = 0 group by file_id, ordinal"""
_COLUMNS = f"""with cols as (
  select 'favor_csv_header' as dictionary, feed, file_seq, file_id, ordinal, name, type, {_SENSE} as sense, delivered_at from ({_USABLE})
  union all select 'vep_output_format', '', release, release, ordinal, name, lower(trim(coalesce(type, ''))), {_SENSE}, released_at from vep_output_format)"""

# packed fields: a value is sub-fields between separators, each of them quoted as a whole or bare, up to a delimiter
_Q = """(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')"""
_PIECE = rf"[ \r\f\v]*((?:{_Q}[ \r\f\v]*|[^,;\n\t|]*)(?:\|(?:{_Q}[ \r\f\v]*|[^,;\n\t|]*))*)(?:[,;\n\t]|$)"
_TERM = rf"[ \r\f\v]*((?:{_Q}|[^,;&|/\n\t]*)[ \r\f\v]*)(?:[,;&|/\n\t]|$)"
_TERM_BARE = r"[ \r\f\v]*([^,;&|/\n\t]*)(?:[,;&|/\n\t]|$)"


def packed_sql(field: str, piece: str = _PIECE) -> str:
    """A list of {raw, value} of a packed field."""
    found = rf"list_transform(regexp_extract_all({field}, '{piece}', 1), lambda x: regexp_replace(x, '\s+$', ''))"
    value = f"case when regexp_full_match(x, '{_Q}') then replace(substring(x, 2, length(x) - 2), x[1] || x[1], x[1]) else x end"
    return rf"case when {field} is null or regexp_full_match({field}, '\s*\.?\s*') then [] else list_filter(list_transform({found}, lambda x: {{'raw': x, 'value': {value}}}), lambda x: x.value <> '') end"


_SUBS = rf"regexp_extract_all(raw || '|', '({_Q}[ \r\f\v]*|[^|]*)\|', 1)"
_OPEN = "regexp_matches({0}, '^[\"'']')"
_PACKED = f"""with f as (select 'CSQ' as field, variant_idx as row_id, {packed_sql('info.CSQ')} as vs from variants union all select 'ANN', variant_idx, {packed_sql('info.ANN')} from variants
  union all select 'Term', so_id, {packed_sql('term', _TERM)} from so_consequence),
p2 as (select field, row_id, unnest(generate_series(1, len(vs)))::int as pos, unnest(vs) as v from f),
p as (select field, row_id, pos, v.raw as raw, v.value as value from p2)"""

# lines: laid out by the header of their file, cut, and judged
_MISSING = "('', 'NA', '.')"
_AT = "coalesce(fields[list_position(names, '{0}')], '')"
_BARE = "regexp_replace(lower({0}), '^chr', '')"
_JUDGED = _COLUMNS + rf""",
ided as (select *, case when sense <> '' then sense else chr(0) || lower(name) end as identity from cols where dictionary = 'favor_csv_header'),
lay as (select file_id, list(name order by ordinal) as names, list(type order by ordinal) as types, list(identity order by ordinal) as ids from ided group by file_id),
raws as (select line_id, file_id, raw, names, types, ids, raw is null or regexp_full_match(',' || raw, '(?:,(?:"(?:[^"]|"")*"|[^",]*))+') as ok_quotes from conversionfavor left join lay using (file_id)),
cuts as (select *, case when ok_quotes and raw is not null then list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: case when x[1] = '"' then replace(substring(x, 2, length(x) - 2), '""', '"') else x end) else [] end as fields from raws),
counted as (select *, coalesce(ok_quotes and len(fields) = len(names) and len(names) > 0, false) as ok_count from cuts),
keyed as (select *, {_AT.format('chromosome')} as k_chr, {_AT.format('position')} as k_pos, {_AT.format('ref_vcf')} as k_ref, {_AT.format('alt_vcf')} as k_alt, regexp_split_to_array({_AT.format('variant_vcf')}, '[-_:]') as k from counted),
judged as (select *, ok_count and regexp_full_match(k_chr, '(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X|Y)') and regexp_full_match(k_pos, '[0-9]+') and coalesce(try_cast(k_pos as hugeint) between 1 and 2147483647, false)
  and regexp_full_match(k_ref, '[ACGTNacgtn]+') and regexp_full_match(k_alt, '[ACGTNacgtn]+') and len(k) = 4 and {_BARE.format('k[1]')} = {_BARE.format('k_chr')} and k[2] = k_pos and lower(k[3]) = lower(k_ref) and lower(k[4]) = lower(k_alt)
  and coalesce(list_bool_and(list_transform(range(1, len(fields) + 1), lambda i: names[i] in ('variant_vcf', 'chromosome', 'position', 'ref_vcf', 'alt_vcf') or fields[i] in {_MISSING} or case types[i]
    when 'numeric' then regexp_full_match(fields[i], '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') when 'integer' then regexp_full_match(fields[i], '[+-]?[0-9]+') when 'logical' then fields[i] in ('TRUE', 'FALSE') else true end)), true) as ok_values from keyed)"""
_QUOTES = "length(concat_ws('', column_name, type, description)) - length(replace(concat_ws('', column_name, type, description), '\"', ''))"


def _union_sql(dictionary: str) -> str:
    """u: names and types of the union schema by identity."""
    return f"""folded as (select case when sense <> '' then sense else chr(0) || lower(name) end as identity, max(case type when 'logical' then 1 when 'integer' then 2 when 'numeric' then 3 else 4 end) as r,
  min({{'a': delivered_at, 'b': file_id, 'c': ordinal, 'd': lower(name)}}) as first from cols where dictionary = '{dictionary}' group by 1),
u as (select identity, first.d || case when row_number() over w > 1 then '_' || row_number() over w else '' end as column_name, r from folded window w as (partition by first.d order by first, identity))"""


def _cells_sql(keys: str) -> str:
    """Filled cells by type from ``cells`` (keys, identity, v)."""
    number = "case v when 'TRUE' then '1' when 'FALSE' then '0' else v end"
    flag = "case when v in ('TRUE', 'T', 'YES', '1') then true when v in ('FALSE', 'F', 'NO', '0') then false end"
    cells = f"select {keys}, column_name, case when r = 4 then v end as text, case when r = 3 then try_cast({number} as double) end as number, case when r = 2 then try_cast({number} as bigint) end as whole, case when r = 1 then {flag} end as flag"
    return f"select * from ({cells} from cells join u using (identity) where v not in {_MISSING}) where text is not null or number is not null or whole is not null or flag is not null"


SQL = {
    "p1_line_values": _JUDGED + ", " + _union_sql("favor_csv_header") + ", cells as (select line_id, file_id, unnest(ids) as identity, unnest(fields) as v from judged where ok_values) " + _cells_sql("line_id, file_id"),
    "p1_record_values": _COLUMNS + ", " + _union_sql("vep_output_format") + rf""",
lay as (select file_id as release, list(case when sense <> '' then sense else chr(0) || lower(name) end order by ordinal) as ids from cols where dictionary = 'vep_output_format' group by 1),
recs as (select variant_idx, vep_release as release, {packed_sql('info.CSQ')} as vs from variants),
rec as (select variant_idx, release, unnest(generate_series(1, len(vs)))::int as pos, unnest(vs).value as value from recs),
cut as (select variant_idx, pos, release, ids, string_split(value, '|') as parts from rec join lay using (release)),
cells as (select variant_idx, pos, release, unnest(ids) as identity, unnest(list_transform(range(1, len(ids) + 1), lambda i: case when i = len(ids) then array_to_string(parts[i:], '|') else parts[i] end)) as v from cut) """ + _cells_sql("variant_idx, pos, release"),
    "p2_found": _PACKED + " select field, row_id, pos, value from p",
    "p2_flags": _PACKED + f""", q as (select field, value <> raw as quoted, case when value = raw and (case when field = 'Term' then {_OPEN.format('raw')}
  else len(list_filter({_SUBS}, lambda x: {_OPEN.format('x')} and not regexp_full_match(x, '{_Q}[ \r\f\v]*'))) > 0 end) then 'malformed_quote' else '' end as error from p) select field, quoted, error, count(*) as n from q group by all""",
    "p3_found": _JUDGED + rf""" select 'conversionfavor' as dictionary, line_id as row_id, case when not ok_quotes then 'quoting' when not ok_count then 'column_count' else 'bad_value' end as reason from judged where not ok_values
  union all select 'favor_csv_header', header_id, case when ({_QUOTES}) % 2 = 1 then 'quoting' else 'bad_value' end from favor_csv_header where ({_QUOTES}) % 2 = 1
    or not coalesce(regexp_full_match(column_name, '[A-Za-z0-9_.]+') and regexp_replace(lower(coalesce(type, '')), '^\s+|\s+$', '', 'g') in ('logical', 'integer', 'numeric', 'character'), false)""",
    "p3_loaded": _JUDGED + " select line_id, file_id, len(fields)::int as n_fields from judged where ok_values",
    "p1_found": _COLUMNS + """,
files as (select distinct dictionary, feed, file_seq, file_id from cols),
pairs as (select dictionary, file_id, lag(file_id) over (partition by dictionary, feed order by file_seq, file_id) as prev from files),
o as (select p.dictionary, p.file_id, c.name, c.type, c.sense, c.ordinal from pairs p join cols c on c.dictionary = p.dictionary and c.file_id = p.prev),
n as (select p.dictionary, p.file_id, c.name, c.type, c.sense, c.ordinal from pairs p join cols c on c.dictionary = p.dictionary and c.file_id = p.file_id where p.prev is not null),
gone as (select *, row_number() over (partition by dictionary, file_id, type, sense order by ordinal) as k from o where not exists (from n where n.dictionary = o.dictionary and n.file_id = o.file_id and n.name = o.name)),
come as (select *, row_number() over (partition by dictionary, file_id, type, sense order by ordinal) as k from n where not exists (from o where n.dictionary = o.dictionary and n.file_id = o.file_id and n.name = o.name))
select dictionary, file_id, 'retyped' as change, name as old_name, name as new_name from o join n using (dictionary, file_id, name) where o.type <> n.type
union all select coalesce(g.dictionary, c.dictionary), coalesce(g.file_id, c.file_id), case when g.name is null then 'added' when c.name is null then 'removed' else 'renamed' end,
  coalesce(g.name, ''), coalesce(c.name, '') from gone g full join come c on g.dictionary = c.dictionary and g.file_id = c.file_id and g.type = c.type and g.sense = c.sense and g.k = c.k and g.sense <> ''""",
    "p1_schema": _COLUMNS + """,
f as (select dictionary, case when sense <> '' then sense else lower(name) end as identity, max(case type when 'logical' then 1 when 'integer' then 2 when 'numeric' then 3 else 4 end) as r,
  min({'a': delivered_at, 'b': file_id, 'c': ordinal, 'd': lower(name)}) as first, count(distinct file_id) as n_files from cols group by all)
select dictionary, first.d || case when row_number() over w > 1 then '_' || row_number() over w else '' end as column_name, ['logical', 'integer', 'numeric', 'character'][r] as type, n_files
from f window w as (partition by dictionary, first.d order by first, identity)""",
    "p4_profile": f"""with x as ({_VALUES})
select load_id, column_name, count(*) as n_rows, count(*) - count(v) as n_null, count(*) filter (isnan(v)) as n_nan, count(*) filter (isinf(v)) as n_infinite,
  count(distinct v) filter (isfinite(v)) as n_distinct, min(v) filter (isfinite(v)) as min_finite, max(v) filter (isfinite(v)) as max_finite from x group by load_id, column_name""",
    "p4_distribution": f"""with x as ({_VALUES}),
y as (select x.*, min_value, max_value from x left join column_profile using (column_name))
select load_id, column_name, count(*) as n_rows, count(*) - count(v) as n_null, count(*) filter (isnan(v)) as n_nan, count(*) filter (isinf(v)) as n_infinite,
  case when count(min_value) > 0 and count(max_value) > 0 then count(*) filter (isfinite(v) and not v between min_value and max_value) end as n_outside,
  count(distinct v) filter (isfinite(v)) as n_distinct, min(v) filter (isfinite(v)) as min_finite, quantile_cont(v, 0.25) filter (isfinite(v)) as q25, median(v) filter (isfinite(v)) as median,
  quantile_cont(v, 0.75) filter (isfinite(v)) as q75, max(v) filter (isfinite(v)) as max_finite from y group by load_id, column_name""",
    "p4_footers": f"""with x as ({_VALUES})
select column_name, count(*) as n_rows, count(*) - count(v) as n_null, count(distinct v) as n_distinct, min(v) filter (not isnan(v)) as low, max(v) filter (not isnan(v)) as high from x group by column_name""",
    "p4_found": f"""with x as ({_VALUES}),
y as (select load_id, p.*, v, coalesce(isfinite(v), false) as ok from x join column_profile p using (column_name) where load_id is not null),
g as (select load_id, column_name, any_value(null_share) as ns, any_value(q25) as q25, any_value(q75) as q75, count(*) as n, count(*) - count(v) as nulls, count(*) filter (v is not null and not ok) as odd,
  count(*) filter (ok) as f, count(distinct v) filter (ok) as dist, count(*) filter (ok and not v between min_value and max_value) as outside, median(v) filter (ok and v between min_value and max_value) as med from y group by 1, 2)
select load_id, column_name, issue from (select *, unnest([case when nulls / n > ns + 0.2 then 'null_rate' end, case when odd > 0 then 'not_finite' end, case when outside > 0 then 'range' end,
  case when dist * 10 < f then 'distinct' end, case when med < q25 or med > q75 then 'shift' end]) as issue from g) where issue is not null""",
}

_DISTRIBUTION, _FOUND = SQL["p4_distribution"], SQL["p4_found"]
_BY_LOAD = "select load_id, unnest(['cadd_phred', 'linsight', 'apc_conservation']) as column_name, unnest([info.cadd_phred, null, load_id::float])::double as v from variants where load_id is not null"
SQL |= {
    "p4_chunks": "select unnest(['linsight', 'apc_conservation']) as column_name, count(*) as n_rows, true as settled from variants where load_id is not null",
    "p4_by_load": _FOUND.replace(_VALUES, _BY_LOAD),
    "p4_changes": f"""with prof as ({_DISTRIBUTION}), s as (select load_id, column_name, n_null / n_rows as null_share, median, q75 - q25 as spread,
  case when n_rows - n_null - n_nan - n_infinite > 0 then n_distinct / (n_rows - n_null - n_nan - n_infinite) end as distinct_share from prof where load_id is not null)
select * from (select load_id, column_name, lag(load_id) over w as previous_load, """
    + ", ".join(f"round({c} - lag({c}) over w, 6) as {c}_change" for c in ("null_share", "median", "spread", "distinct_share"))
    + " from s window w as (partition by column_name order by load_id)) where previous_load is not null",
    "p4_patterns": " union all ".join(f"select load_id, '{n}' as column_name, count({c}) as n_values, count(*) filter ({c} is not null and not regexp_full_match({c}, '{p}')) as n_violations from variants group by load_id" for n, (c, p) in PATTERNS.items()),
}
