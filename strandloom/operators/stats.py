"""Additive statistics of annotated variants in one pass.

Every variant and every record is melted into (stat, category) pairs that one aggregate counts: partial sums on the map side,
one shuffle of as many rows as there are distinct categories a task.  Where records lie in their variant's row, as importers
leave them, the most severe consequence of a variant is read off its row; where they are a table of their own, the least rank
of a variant goes through the same aggregate under the variant's number.  Every table is read once.  Counters of separate files
or loads add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.dictionaries import SO_TERMS
from strandloom.functions import annotation as A

RECORD_FIELDS = ("impact", "biotype", "feature_type", "feature")
IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")


PAIRS = "array<struct<stat:string,category:string,rank:int>>"
#: Rows of the aggregate that stand for a variant, not for a counter.
VARIANT = "_variant"


def _pair(stat: str, category: Column, rank: Column | None = None) -> Column:
    return F.struct(F.lit(stat).alias("stat"), category.cast("string").alias("category"), (F.lit(None) if rank is None else rank).cast("int").alias("rank"))


def _none() -> Column:
    return F.array().cast(PAIRS)


def _when(stat: str, keep: Column, category: Column) -> Column:
    return F.when(keep, F.array(_pair(stat, category))).otherwise(_none())


def _each(stat: str, values: Column) -> Column:
    """Pairs of the non-null members of an array; a null array has none."""
    return F.coalesce(F.transform(F.array_compact(values), lambda v: _pair(stat, v)), _none())


def _chosen(parts: dict[str, Column], only: set[str] | None) -> Column:
    """The pairs of all counters, or of the named ones."""
    got = [c for n, c in parts.items() if only is None or n in only]
    return F.concat(*got) if got else _none()


def variant_pairs(only: set[str] | None = None) -> Column:
    """Pairs of a variant; ``only`` names the counters that are asked for."""
    c = F.col
    ref, alts = F.coalesce(c("ref"), F.lit("")), A.alts(c("alt"))
    classed = F.transform(alts, lambda a: F.struct(A.variant_class(ref, a).alias("k"), a.alias("a")))
    known = c("id").isNotNull() & ~c("id").isin("", ".")
    no_qual = c("qual").isNull() | F.isnan("qual")
    parts = {
        "n_var": F.array(_pair("n_var", F.lit("n"))),
        "n_allele": F.array(_pair("n_allele", F.size(alts) + 1)),
        "known": F.array(_pair("known", F.when(known, "known").otherwise("novel"))),
        "chrom": _when("chrom", c("chr").isNotNull(), c("chr")),
        "var_class": _each("var_class", F.transform(classed, lambda x: x["k"])),
        "base_change": _each("base_change", F.transform(F.filter(classed, lambda x: x["k"] == "SNV"), lambda x: F.concat(F.upper(ref), F.lit(">"), F.upper(x["a"])))),
        "indel_len": _each("indel_len", F.transform(F.filter(classed, lambda x: x["k"].isin("insertion", "deletion")), lambda x: A.clip(F.length(x["a"]) - F.length(ref)))),
        "qual_na": _when("qual_na", no_qual, F.lit("NA")),
        "qual": _when("qual", ~no_qual, A.qual_bin(c("qual"))),
        "filter": _when("filter", c("filter").isNotNull(), c("filter")),
    }
    return _chosen(parts, only)


def record_pairs(of=F.col, only: set[str] | None = None) -> Column:
    """Pairs of a record; ``of`` gives the column of a slot, ``only`` names the counters that are asked for."""
    c = of
    terms = A.so_terms(c("consequence"))
    full = lambda n: c(n).isNotNull() & (c(n) != "")
    parts = {
        "n_annot": F.array(_pair("n_annot", F.lit("n"))),
        "cons_all": _each("cons_all", terms),
        "region": _each("region", F.transform(terms, A.so_region)),
        "func_class": _each("func_class", F.transform(terms, A.so_class)),
        **{n: _when(n, full(n), c(n)) for n in RECORD_FIELDS},
        **{n: _when(n, full(n), A.before_parenthesis(c(n))) for n in ("sift", "polyphen")},
        "errors": F.when(full("errors"), _each("errors", F.split(c("errors"), "&"))).otherwise(_none()),
        "gene_impact": _when("gene_impact", full("gene"), F.concat(c("gene"), F.lit("\r"), F.coalesce(c("impact"), F.lit("")))),
    }
    return _chosen(parts, only)


def _severe(rank: Column) -> Column:
    """Pairs of a variant by the rank of its most severe known term; none where that is null."""
    term = A.so_term(rank)
    return F.when(rank.isNotNull(), F.array(_pair("cons_severe", term), _pair("impact_severe", A.so_impact(term)))).otherwise(_none())


def count_pairs(df: DataFrame, pairs: Column) -> DataFrame:
    return df.select(F.explode(pairs).alias("p")).groupBy("p.stat", "p.category").agg(F.count(F.lit(1)).alias("n")).select("stat", "category", "n")


def counters(variants: DataFrame | None = None, records: DataFrame | None = None, only: set[str] | None = None) -> DataFrame:
    """(stat, category, n) of all counters that the given tables allow, or of those that ``only`` names."""
    severe = only is None or not only.isdisjoint(("cons_severe", "impact_severe"))
    if records is None:
        return count_pairs(variants, variant_pairs(only))
    if not severe and variants is None:
        return count_pairs(records, record_pairs(only=only))
    of_variant = F.array(_pair(VARIANT, F.col("variant_idx"), A.so_rank(F.col("consequence")))) if severe else _none()
    rows = records.select(F.explode(F.concat(record_pairs(only=only), of_variant)).alias("p"))
    if variants is not None:
        rows = rows.unionByName(variants.select(F.explode(variant_pairs(only)).alias("p")))
    once = rows.groupBy("p.stat", "p.category").agg(F.count(F.lit(1)).alias("n"), F.min("p.rank").alias("rank"))
    # variants become counts of their most severe term; counters pass as they are
    counted = F.struct("stat", "category", "n")
    as_one = F.transform(_severe(F.col("rank")), lambda p: F.struct(p["stat"].alias("stat"), p["category"].alias("category"), F.lit(1).cast("bigint").alias("n")))
    final = once.select(F.explode(F.when(F.col("stat") == VARIANT, as_one).otherwise(F.array(counted))).alias("x"))
    return final.groupBy("x.stat", "x.category").agg(F.sum("x.n").alias("n")).select("stat", "category", "n")


def annotated_counters(df: DataFrame) -> DataFrame:
    """All counters of a table whose records lie in the rows of their variants, as the importers of VEP and SnpEff leave them: one
    read, one shuffle.  Slots that the annotator does not fill count nothing; without records only variants are counted."""
    from strandloom.operators import catalog

    root, slots = catalog.profile(df)
    if root is None:
        return counters(df)
    records = F.col(f"{root}.list") if "list" in getattr(df.schema[root].dataType, "names", []) else F.col(root)
    uniform = set(slots.values()) - set(df.select(F.explode(records).alias("r")).select("r.*").columns)
    if uniform:
        slots = {s: n for s, n in slots.items() if n not in uniform}

    def of(record: Column):
        return lambda slot: record[slots[slot]].cast("string") if slot in slots else F.lit(None).cast("string")

    each = F.coalesce(F.flatten(F.transform(records, lambda r: record_pairs(of(r)))), _none())
    rank = F.array_min(F.transform(records, lambda r: A.so_rank(of(r)("consequence")))) if "consequence" in slots else F.lit(None).cast("int")
    return count_pairs(df, F.concat(variant_pairs(), each, _severe(rank)))


def annotated_records(df: DataFrame) -> DataFrame:
    """The records of such a table as rows: variant_idx, record_no and the slots of ``catalog.SLOTS`` as columns; slots that the
    annotator does not fill are null."""
    from strandloom.operators import catalog

    root, slots = catalog.profile(df)
    if root is None:
        raise ValueError("no annotation records")
    records = F.col(f"{root}.list") if "list" in getattr(df.schema[root].dataType, "names", []) else F.col(root)
    rows = df.select("variant_idx", F.posexplode(records).alias("_i", "_r"))
    names = ["gene", "consequence", "impact", "feature", "feature_type", "biotype", "sift", "polyphen", "errors"]
    return rows.select("variant_idx", (F.col("_i") + 1).alias("record_no"), *[(F.col(f"_r.`{slots[n]}`").cast("string") if n in slots else F.lit(None).cast("string")).alias(n) for n in names])


def merge(*parts: DataFrame) -> DataFrame:
    """Counters of several files or loads as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stat", "category").agg(F.sum("n").cast("bigint").alias("n"))


def merge_ranges(*parts: DataFrame) -> DataFrame:
    """Ranges of chromosomes of several files or loads as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("chr").agg(F.min("pos_min").alias("pos_min"), F.max("pos_max").alias("pos_max"))


def position_ranges(variants: DataFrame) -> DataFrame:
    return variants.where("chr is not null").groupBy("chr").agg(F.min("position").alias("pos_min"), F.max("position").alias("pos_max"))


def histogram(counted: DataFrame) -> DataFrame:
    """The bins of QUAL, empty ones included."""
    bins = counted.sparkSession.createDataFrame(list(enumerate(A.qual_labels())), "bin int, category string")
    return bins.join(counted.where("stat = 'qual'"), "category", "left").select("bin", "category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def gene_table(records: DataFrame) -> DataFrame:
    """gene, total, one column per impact (others and missing ones as other and unknown)."""
    im = F.when(F.coalesce(F.col("impact"), F.lit("")) == "", "unknown").when(F.col("impact").isin(*IMPACTS), F.col("impact")).otherwise("other")
    names = [*IMPACTS, "other", "unknown"]
    rows = records.where("gene is not null and gene <> ''").select("gene", im.alias("k"))
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("k") == n, 1)).alias(n) for n in names])


def base_matrix(variants: DataFrame) -> DataFrame:
    """ref and counts of each alternate base."""
    rows = variants.select(F.coalesce("ref", F.lit("")).alias("ref"), F.explode(A.alts(F.col("alt"))).alias("a")).where(A.variant_class(F.col("ref"), F.col("a")) == "SNV")
    rows = rows.select(F.upper("ref").alias("ref"), F.upper("a").alias("a")).where(F.col("ref").isin(*"ACGT"))
    return rows.groupBy("ref").agg(*[F.count(F.when(F.col("a") == b, 1)).alias(b) for b in "ACGT"])


def ts_tv(counted: DataFrame) -> DataFrame:
    """n_ts, n_tv, ratio of base-change counters."""
    ts = F.col("category").isin("A>G", "G>A", "C>T", "T>C")
    ok = F.col("category").rlike("^[ACGT]>[ACGT]$") & (F.substring("category", 1, 1) != F.substring("category", 3, 1))
    x = counted.where((F.col("stat") == "base_change") & ok).agg(F.coalesce(F.sum(F.when(ts, F.col("n"))), F.lit(0)).alias("n_ts"), F.coalesce(F.sum(F.when(~ts, F.col("n"))), F.lit(0)).alias("n_tv"))
    return x.select("n_ts", "n_tv", F.when(F.col("n_tv") > 0, F.round(F.col("n_ts") / F.col("n_tv"), 6)).alias("ratio"))


def missense_silent(counted: DataFrame) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("category") == k, F.col("n")))
    x = counted.where("stat = 'func_class'").agg(n("MISSENSE").alias("missense"), n("SILENT").alias("silent"))
    return x.select("missense", "silent", F.round(F.col("missense") / F.col("silent"), 6).alias("ratio"))


def variant_rate(variants: DataFrame) -> DataFrame:
    """span (sum of the ranges of chromosomes), n_variant, rate (bases to a variant)."""
    per = variants.where("chr is not null").groupBy("chr").agg((F.max("position") - F.min("position") + 1).cast("bigint").alias("s"), F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("s").alias("span"), F.sum("k").alias("n_variant")).select("span", "n_variant", F.round(F.col("span") / F.col("n_variant"), 6).alias("rate"))


def percent_of_total(counted: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    total = F.sum("n").over(Window.partitionBy("stat"))  # over counters, of which there are few
    return counted.select("stat", "category", "n", F.round(F.col("n") * 100 / total, 2).alias("percent"))
