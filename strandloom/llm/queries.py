"""Queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import abuse, mix, percentiles, terms, tokenize
from strandloom.session import read, ship

# ---- 5: frequency of every distinct value or term


def _term_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the three tables as (field, terms, record)."""
    one = lambda c: F.array(terms.tidy(c))

    def rows(table: str, columns: list, fields: dict) -> DataFrame:
        df = read(spark, d, table).select(*columns, F.monotonically_increasing_id().alias("record"))
        x = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("terms")) for n, c in fields.items()])).alias("x")
        return df.select("record", x).select("x.field", "x.terms", "record")

    c = F.col
    variants = rows("variants", [c("info.variant_type").alias("variant_type")], {"variants.info.variant_type": one(c("variant_type"))})
    records = rows("records", ["consequence", "impact"], {"records.consequence": terms.term_list(c("consequence")), "records.impact": one(c("impact"))})
    so = rows("so_consequence", ["term", "impact"], {"so_consequence.term": terms.term_list(c("term")), "so_consequence.impact": one(c("impact"))})
    return variants.unionByName(records).unionByName(so)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return terms.frequencies(_term_rows(spark, d)).where("mark <> ''").select("field", "value", "mark")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return terms.frequencies(_term_rows(spark, d)).select("field", "value", "occurrences", "records", F.round("share", 6).alias("share"), "mark")


_P5 = r"""
with raw(field, record, value) as (
  select 'variants.info.variant_type', variant_idx * 1000, info.variant_type from variants
  union all select 'records.consequence', rn, unnest(regexp_split_to_array(consequence, '[&,;|/\n\t]')) from (select consequence, row_number() over () rn from records)
  union all select 'records.impact', rn, impact from (select impact, row_number() over () rn from records)
  union all select 'so_consequence.term', so_id, unnest(regexp_split_to_array(term, '[&,;|/\n\t]')) from so_consequence
  union all select 'so_consequence.impact', so_id, impact from so_consequence),
t as (select field, record, lower(regexp_replace(regexp_replace(value, '^[\s"'']+', ''), '[\s"'']+$', '')) as value from raw),
v as (select * from t where value <> ''),
per as (select field, value, count(*) as occurrences, count(distinct record) as records from v group by all),
tot as (select field, count(distinct record) as n from v group by field),
res as (select field, value, occurrences, records, records / n as share,
  case when records <= 2 then 'rare' when records / n >= 0.2 then 'common' else '' end as mark from per join tot using (field))
"""

# ---- 6: percentiles

QS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
METRICS = ("cadd_phred", "linsight", "apc_epigenetics")
KEYS = ["dimension", "grp", "metric"]


def _sketch_by_load(spark: SparkSession, d: str) -> DataFrame:
    """One sketch for each load, chromosome and variant type: what a day's job would leave behind."""
    v = read(spark, d, "variants")
    rows = v.select(
        F.coalesce(F.col("load_id").cast("string"), F.lit("")).alias("load"),
        F.coalesce(F.regexp_replace("chr", "^chr", ""), F.lit("")).alias("chr"),
        F.coalesce(F.lower(F.trim("info.variant_type")), F.lit("")).alias("type"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"info.{m}").cast("double").alias("value")) for m in METRICS])).alias("x"),
    ).select("load", "chr", "type", "x.*")
    return percentiles.sketch(rows, ["load", "chr", "type", "metric"])


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single loads combined along each dimension."""
    by_load = _sketch_by_load(spark, d)
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("grp")) for n, c in (("chr", "chr"), ("variant_type", "type"), ("load", "load"))])).alias("d")
    along = by_load.select(dims, "metric", "sign", "bucket", "n").select("d.dimension", "d.grp", "metric", "sign", "bucket", "n")
    got = percentiles.percentiles(percentiles.combine(along), KEYS, QS)
    return got.select(*KEYS, "n", *[F.round(q, 6).alias(q) for q in QS])


def p6_exact_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per metric over all rows: percentiles of the sketch beside the exact ones, and the error against the one stated."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"info.{m}").cast("double").alias("value")) for m in METRICS])).alias("x")
    got = percentiles.measured_error(read(spark, d, "variants").select(each).select("x.*"), ["metric"], QS)
    within = (F.col("relative_error") <= percentiles.ACCURACY * (1 + 1e-9)).alias("within_stated")
    return got.select("metric", "percentile", "n", F.lit(percentiles.ACCURACY).alias("stated_error"), "exact", F.round("estimate", 6).alias("estimate"), F.round("relative_error", 6).alias("relative_error"), within)


def _p6_sql(keys: str, source: str, extra: str = "") -> str:
    qs = ", ".join(f"round(max(case when up_to > floor({q} * (all_of - 1)) and up_to - n <= floor({q} * (all_of - 1)) then est end), 6) as {name}" for name, q in QS.items())
    return f"""with vals as (select load_id, chr, info.variant_type as vt, unnest(['cadd_phred', 'linsight', 'apc_epigenetics']) as metric,
  unnest([info.cadd_phred, info.linsight, info.apc_epigenetics])::double as v from variants),
b as ({source}),
s as (select {keys}, case when v > 0 then 1 when v < 0 then -1 else 0 end as sign, case when v = 0 then 0 else ceil(ln(abs(v)) / ln(1.01 / 0.99)) end as bucket, count(*) as n
  from b where isfinite(v) group by all),
r as (select *, sum(n) over (partition by {keys} order by sign, sign * bucket rows unbounded preceding) as up_to, sum(n) over (partition by {keys}) as all_of,
  sign * 2 * pow(1.01 / 0.99, bucket) / (1.01 / 0.99 + 1) as est from s)
select {keys}, max(all_of)::bigint as n, {extra} {qs} from r group by {keys}"""


# ---- 7: encoding


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return tokenize.encode(read(spark, d, "documents"))


# ---- 8: mixing


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, with repeats."""
    ship(spark)
    targets = read(spark, d, "mix_targets")
    sized = mix.sizes_of(read(spark, d, "documents"), targets)
    return mix.choose(sized, mix.plan(sized, targets))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    ship(spark)
    targets = read(spark, d, "mix_targets")
    sized = mix.sizes_of(read(spark, d, "documents"), targets)
    return mix.shares(sized, mix.plan(sized, targets))


def _clamped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sizes, and the plan of a mix as large as all tokens of the sources with a target: those short of documents are clamped at
    their repetitions, and the others take their excess."""
    ship(spark)
    targets = read(spark, d, "mix_targets")
    sized = mix.sizes_of(read(spark, d, "documents"), targets)
    total = sized.agg(F.sum("n_tokens")).first()[0]
    return sized, mix.plan(sized, targets, total_tokens=total)


def p8_mix_all(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a mix of as many tokens as there are, with repeats."""
    return mix.choose(*_clamped(spark, d))


def p8_shares_all(spark: SparkSession, d: str) -> DataFrame:
    """The shares that a mix of as many tokens as there are reaches."""
    return mix.shares(*_clamped(spark, d))


def p8_plan_chars(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a mix by characters, as large as all sources with a target: some are clamped, others take their excess."""
    targets = read(spark, d, "mix_targets")
    sized = read(spark, d, "documents").join(targets.where("source is not null").select("source").distinct(), "source", "left_semi").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_tokens"))
    total = sized.agg(F.sum("n_tokens")).first()[0]
    got = mix.plan(sized, targets, total_tokens=total)
    return got.select("source", "target_share", "max_repeats", "available", F.round("wanted", 3).alias("wanted"), F.round("epochs", 6).alias("epochs"), (F.abs(F.col("epochs") - F.col("max_repeats")) < 1e-9).alias("clamped"))


# ---- 9: abusive content


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return abuse.score(read(spark, d, "documents"), ["doc_id"]).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return abuse.score(read(spark, d, "documents"), ["doc_id"])


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return abuse.rates(abuse.score(read(spark, d, "documents"), ["doc_id", "source"]))


QUERIES = {
    f.__name__: f
    for f in (p5_found, p5_frequencies, p6_percentiles, p6_exact_bound, p7_ids, p8_mix, p8_shares, p8_mix_all, p8_shares_all, p8_plan_chars, p9_found, p9_scores, p9_rates)
}

_DIMENSIONS = """select 'chr' as dimension, coalesce(regexp_replace(chr, '^chr', ''), '') as grp, metric, v from vals
  union all select 'variant_type', coalesce(lower(trim(vt)), ''), metric, v from vals
  union all select 'load', coalesce(load_id::varchar, ''), metric, v from vals"""

SQL = {
    "p5_found": _P5 + "select field, value, mark from res where mark <> ''",
    "p5_frequencies": _P5 + "select field, value, occurrences, records, round(share, 6) as share, mark from res",
    "p6_percentiles": _p6_sql("dimension, grp, metric", _DIMENSIONS),
    "p6_exact_bound": f"""with vals as (select unnest(['cadd_phred', 'linsight', 'apc_epigenetics']) as metric, unnest([info.cadd_phred, info.linsight, info.apc_epigenetics])::double as v from variants),
r as (select metric, v, row_number() over (partition by metric order by v) - 1 as place, count(*) over (partition by metric) as n from vals where isfinite(v)),
q as (select unnest({list(QS)}) as percentile, unnest({list(QS.values())}) as q),
e as (select metric, percentile, n, v as exact, case when v = 0 then 0.0 else sign(v) * 2 * pow(1.01 / 0.99, ceil(ln(abs(v)) / ln(1.01 / 0.99))) / (1.01 / 0.99 + 1) end as estimate from r join q on place = floor(q * (n - 1)))
select metric, percentile, n, 0.01::double as stated_error, exact, round(estimate, 6) as estimate, round(case when exact = 0 then abs(estimate) else abs(estimate - exact) / abs(exact) end, 6) as relative_error, true as within_stated from e""",
    # what is left after the first k sources by cap / weight are clamped, over the weights of the others: the first k that fits
    "p8_plan_chars": """with t as (select source, max({'a': target_share, 'b': max_repeats}) as m from mix_targets where source is not null group by source),
h as (select source, sum(coalesce(n_chars, 0))::bigint as available from documents group by source),
s as (select source, m.a as target_share, m.b as max_repeats, coalesce(available, 0)::bigint as available, greatest(coalesce(m.a, 0), 0) as w, (coalesce(m.b, 0) * coalesce(available, 0))::double as most from t left join h using (source)),
o as (select *, sum(available) over () as total, case when w > 0 and most > 0 then most / w end as bend from s),
c as (select *, coalesce(sum(most) over (order by bend, source rows between unbounded preceding and 1 preceding), 0) as full_before, sum(w) over (order by bend, source rows between current row and unbounded following) as open_w from o where bend is not null),
level as (select arg_min((total - full_before) / open_w, (bend, source)) filter ((total - full_before) / open_w <= bend) as l from c)
select source, target_share, max_repeats, available, round(case when bend is null then 0 else least(w * coalesce(l, 1e300), most) end, 3) as wanted,
  round(case when bend is null then 0 else least(w * coalesce(l, 1e300), most) / available end, 6) as epochs, coalesce(available > 0 and bend <= coalesce(l, 1e300), max_repeats = 0) as clamped from o, level""",
}
