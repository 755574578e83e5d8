import datetime

import pytest
from pyspark.sql import functions as F

from strandloom.functions import annotation as A
from strandloom.operators import catalog, counts, lookup, report, stats
from strandloom.sources import favor, tables, vcf

V = "variant_idx long, chr string, position int, ref string, alt string, id string, qual float, filter string, load_id int"
ROWS = [
    (1, "1", 100, "A", "C", "rs1", 5.0, "PASS", 1), (2, "chr1", 100, "A", "C", ".", None, None, 2), (3, "2", 50, "G", "GTT,A", "", float("nan"), "q", 1),
    (4, "2", 20000, "AC", "GT", None, 10.0, "PASS", 1), (5, "X", 7, "A", "<DEL>", "rs2", 2000.0, "PASS", 2), (6, "X", 9, "ACG", "A", "rs3", 10.5, "PASS", 2), (7, None, None, "A", "", "rs4", 0.0, "", 2),
]


@pytest.fixture(scope="module")
def variants(spark):
    return spark.createDataFrame(ROWS, V).withColumn("file_idx", F.col("load_id")).withColumn("info", F.struct(F.col("qual").alias("score"), F.struct(F.col("id").alias("deep")).alias("sub")))


def test_lookup(spark, variants):
    got = lookup.annotate(["1-100-A-C", "chr2:50:G:GTT,A", "9_1_A_C", "1-100-A-C-"], variants, {"s": "score", "d": "sub/deep", "c": ":chromosome"}).collect()
    assert [(r._row, r.s, r.d, r.c) for r in got[:1]] == [(0, 5.0, "rs1", "1")]
    assert got[1].d == "" and got[2].s is None and got[3].s == 5.0 and len(got) == 4
    index = lookup.annotate(["1-100-A-C", "1-1-A-C", "9-1-A-C"], variants, []).collect()
    assert [(r.variant_idx, r.file_idx) for r in index] == [(1, 1), (None, 2), (None, None)]
    df = spark.createDataFrame([("chrX", 9, "ACG", "A", 1)], "chr string, pos int, ref string, alt string, score int")
    assert lookup.annotate(df, variants, ["score"]).first().score == 10.5
    with pytest.raises(ValueError):
        lookup.annotate(df.drop("alt"), variants, ["score"])
    with pytest.raises(Exception, match="not a variant key"):
        lookup.annotate(["1-100-A"], variants, ["score"]).collect()
    with pytest.raises(ValueError):
        lookup.resolve(variants, ["nothing"])


def test_partition_count_does_not_matter(spark, variants):
    keys = spark.createDataFrame([(i, r[1], r[2], r[3], r[4]) for i, r in enumerate(ROWS)], "_row long, chr string, position int, ref string, alt string")
    want = lookup.annotate_rows(keys, variants, ["score"]).orderBy("_row").collect()
    for n in (1, 3, 20):
        assert str(lookup.annotate_rows(keys.repartition(n), variants.repartition(n), ["score"]).orderBy("_row").collect()) == str(want)


def test_ranges(spark, variants):
    r = spark.createDataFrame([("chr1", 90, 110), ("1", 100, 100), ("2", 1, 40000), ("X", 9, 1), (None, 1, 9)], "chr string, start int, end int")
    assert sorted(x.variant_idx for x in lookup.in_ranges(variants, r).collect()) == [1, 2, 3, 4]
    assert [x.variant_idx for x in lookup.in_ranges(variants, r, "X").orderBy("variant_idx").collect()] == [5, 6]


def test_statistics(spark, variants):
    got = {(r.stat, r.category): r.n for r in stats.counters(variants=variants).collect()}
    assert got["n_var", "n"] == 7 and got["n_allele", "3"] == 1 and got["n_allele", "2"] == 6
    assert {k[1]: n for k, n in got.items() if k[0] == "var_class"} == {"SNV": 3, "insertion": 1, "substitution (MNV)": 1, "other": 1, "deletion": 2}
    assert got["indel_len", "2"] == 1 and got["indel_len", "-1"] == 1 and got["known", "known"] == 4 and got["qual_na", "NA"] == 2
    assert got["qual", "(0,10]"] == 2 and got["qual", "(-Inf,0]"] == 1 and got["qual", "(10,20]"] == 1 and got["qual", "(1000,Inf]"] == 1
    halves = [stats.counters(variants=variants.where(c)) for c in ("variant_idx <= 3", "variant_idx > 3")]
    assert {(r.stat, r.category): r.n for r in stats.merge(*halves).collect()} == got
    assert stats.counters(variants=variants.limit(0)).count() == 0
    assert len(stats.histogram(stats.counters(variants=variants)).collect()) == 11


R = "variant_idx long, gene string, consequence string, impact string, feature string, feature_type string, biotype string, sift string, polyphen string, errors string"
RECORDS = [
    (1, "G1", "intron_variant&stop_gained", "HIGH", "T1", "Transcript", "pc", "deleterious(0.1)", "", "W1&W2"), (1, "G1", "odd", None, "T2", "Transcript", "", None, None, ""),
    (2, "", "", "LOW", None, None, None, "", "benign(0.2)", None), (3, None, None, "", "", "", "", "", "", ""), (4, "G2", "missense_variant", "weird", "T1", "x", "pc", "", "", ""),
]


def test_record_statistics(spark):
    r = spark.createDataFrame(RECORDS, R)
    got = {(x.stat, x.category): x.n for x in stats.counters(records=r).collect()}
    assert got["n_annot", "n"] == 5 and got["cons_all", ""] == 1 and got["cons_severe", "stop_gained"] == 1 and got["impact_severe", "MODERATE"] == 1
    assert got["sift", "deleterious"] == 1 and got["errors", "W2"] == 1 and got["gene_impact", "G1\r"] == 1 and got["region", "intron"] == 1
    assert sum(n for (s, _), n in got.items() if s == "cons_severe") == 2
    genes = {x.gene: x for x in stats.gene_table(r).collect()}
    assert genes["G1"].total == 2 and genes["G1"].unknown == 1 and genes["G2"].other == 1 and len(genes) == 2


def test_counts_and_units(spark):
    e = spark.createDataFrame(RECORDS, R).withColumn("chr", F.lit("1")).withColumn("position", F.col("variant_idx").cast("int") * 10)
    assert {r.impact: r.n for r in counts.value_counts(e, {"impact": F.col("impact")}).collect()} == {"HIGH": 1, None: 1, "LOW": 1, "": 1, "weird": 1}
    full = counts.value_counts(e, {"gene": F.col("gene"), "impact": F.col("impact")}, complete=True)
    assert full.count() == 20 and full.agg(F.sum("n")).first()[0] == 5
    blocks = counts.value_counts_blocks(e.select("gene"), lambda b: b.fillna("none").groupby("gene").size().reset_index(name="n"), "gene string, n long")
    assert {r.gene: r.n for r in blocks.collect()} == {"G1": 2, "G2": 1, "": 1, "none": 1}
    got = counts.unit_groups(e, ["gene"], {"sift": lambda c: c != "deleterious(0.1)"}).orderBy("gene").collect()
    assert [(r.gene, r["index"], r.start, r.end) for r in got] == [("G1", [1], 10, 10), ("G2", [4], 40, 40)]
    assert counts.unit_groups(e, ["gene"], {"impact": ["weird"]}).count() == 1
    with pytest.raises(ValueError):
        counts.unit_groups(e, ["nothing"])


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(A.decode_hex(F.lit(r"a\x3bb\x5cx3d"))) == "a;b="
    assert one(A.number(F.lit("5d"))) is None and one(A.number(F.lit(" 1e5 "))) == 1e5 and one(A.whole(F.lit("3.7"))) == 3 and one(A.whole(F.lit("1e99"))) is None
    assert one(A.logical(F.lit("true"))) is False and one(A.logical(F.lit("YES"))) is True and one(A.logical(F.lit(None).cast("string"))) is False
    assert one(A.so_rank(F.lit("odd&stop_gained&intron_variant"))) == 4 and one(A.so_rank(F.lit("odd"))) is None
    assert one(A.pieces(F.lit("a|b|c|d"), 3)) == ["a", "b", "c|d"] and one(A.pieces(F.lit("a"), 3)) == ["a", "", ""]


def test_report(spark, variants, tmp_path):
    got = report.collect(stats.counters(variants, spark.createDataFrame(RECORDS, R)), "t")
    assert "7 variants" in repr(got) and got.n_gene == 2
    for name, mark in (("a.html", "<svg"), ("a.md", "## Base changes"), ("a.json", '"title"')):
        path = report.write_report(got, str(tmp_path / name))
        assert mark in open(path).read()


HEAD = """##fileformat=VCFv4.2
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency, of alleles">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##INFO=<ID=CSQ,Number=.,Type=String,Description="From a tool. Format: Allele|AF|CANONICAL|SYMBOL">
##INFO=<ID=LOF,Number=.,Type=String,Description="Lost: 'Gene_Name | Gene_ID | Number_of_transcripts_in_gene | Percent_of_transcripts_affected'">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
"""


def test_variant_files(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    body = ["22\t10\t.\tA\tC,G\t.\tPASS\tAF=0.5,.;DB;CSQ=C|0.1|YES|G1,G|0.2||G2|more;LOF=(G1|E1|3|0.5)", "22\t11\trs\tA\tC\t7\t.\t."]
    open(path, "w").write(HEAD + "\n".join(body) + "\n")
    a, b = vcf.import_plain(spark, path).orderBy("variant_idx").collect()
    assert (a.variant_idx, a.id, a.info.AF, a.info.DB, a.qual) == (1, None, [0.5, None], True, None) and (b.info.DB, b.qual, b.filter) == (False, 7.0, None)
    df = vcf.import_vep(spark, path).orderBy("variant_idx")
    v, w = df.collect()
    assert [(r.CANONICAL, r.SYMBOL) for r in v.CSQ.list] == [(True, "G1"), (False, "G2|more")] and abs(v.CSQ.uniform.AF - 0.1) < 1e-6 and w.CSQ.list is None and w.CSQ.uniform is None
    assert "CSQ" not in df.schema["info"].dataType.names and catalog.profile(df)[0] == "CSQ"
    lof = vcf.import_snpeff(spark, path).orderBy("variant_idx").first().LOF
    assert (lof[0].Gene_Name, lof[0].Number_of_transcripts_in_gene, lof[0].Percent_of_transcripts_affected) == ("G1", 3, 0.5)
    listed = {r.name: r for r in catalog.annotation_list(vcf.import_plain(spark, path)).collect()}
    assert listed["AF"].trait == "list" and listed["AF"].description == "Frequency, of alleles"


def test_wide_csv_errors(spark, tmp_path):
    a, b = tmp_path / "a_1.csv", tmp_path / "b_2.csv"
    a.write_text("variant_vcf,chromosome,position,ref_vcf,alt_vcf,s\n1-5-A-C,1,5,A,C,2\n1-6-A-C,1,6,A,C,\n")
    b.write_text("variant_vcf,chromosome,position,ref_vcf,alt_vcf,t\n")
    got = favor.read_csv(spark, [str(a)], {"s": "integer"}).orderBy("variant_idx").collect()
    assert [(r.variant_idx, r.info.FAVOR.s, r.allele) for r in got] == [(1, 2, "A,C"), (2, None, "A,C")]
    with pytest.raises(ValueError):
        favor.read_csv(spark, [str(a), str(b)], {})


def test_tables(spark, variants, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(variants.where("chr is not null").drop("file_idx"), path)
    assert tables.open_tables(spark, [path]).count() == 6
    for bad in ([], [path, path]):
        with pytest.raises(ValueError):
            tables.open_tables(spark, bad)


def test_row_numbers(spark, tmp_path):
    for i, n in enumerate((3, 0, 5)):
        (tmp_path / f"{i}.txt").write_text("".join(f"{i}-{k}\n" for k in range(n)))
    df = spark.read.text(str(tmp_path)).repartitionByRange(5, "value").sortWithinPartitions("value")
    got = [(r.value, r.n) for r in vcf.numbered(df, "n").orderBy("n").collect()]
    assert got == [(v, i + 1) for i, v in enumerate(sorted(v for v, _ in got))] and len(got) == 8
    assert vcf.numbered(df.where("false"), "n").count() == 0


def test_row_numbers_of_a_sorted_table(spark):
    # wide rows: adaptive execution merges the partitions when rows are only counted, and not when they are read whole
    text = F.concat_ws("", *[F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 512) for i in range(8)])
    df = spark.range(20_000, numPartitions=4).select(((F.col("id") * 7919 + 5) % 20_000).alias("v"), text.alias("text")).orderBy("v")
    got = vcf.numbered(df, "n").select("v", "n", F.length("text").alias("k")).collect()
    assert len(got) == 20_000 and all(r.n == r.v + 1 and r.k == 1024 for r in got)


FIRST = {
    1: ("T|intron|LOW|G1,A|x|HIGH|G2", "T", "LOW"), 2: ('"T|a,b|LOW|G1",A|x|HIGH|G2', "T", "LOW"), 3: ("A|x|HIGH|G;T|y|LOW|G", "A", "HIGH"), 4: ("A|x|HIGH|G\tT|y|LOW|G", "A", "HIGH"),
    5: ("A|x|HIGH|G\nT|y|LOW|G", "A", "HIGH"), 6: ('  T|"a;b"|LOW|G|more , A|x|HIGH|G', "T", "LOW"), 7: (None, None, None), 8: ("", None, None), 9: (" . ", None, None), 10: (",;,", None, None),
    11: ('"T|a ""b"", c|LOW|G";A|x|HIGH|G', "T", "LOW"), 12: (",,A|x", "A", ""), 13: ("'T|a;b|LOW'", "T", "LOW"), 14: ('"T|a|LOW|G', '"T', "LOW"), 15: ("T|||G", "T", ""),
}


def test_first_records_of_all_variants(spark, tmp_path):
    from strandloom.plans.annotation import QUERIES

    rows = [(i, (text,)) for i, (text, _, _) in FIRST.items()]
    spark.createDataFrame(rows, "variant_idx long, info struct<CSQ:string>").write.parquet(str(tmp_path / "variants.parquet"))
    got = {r.variant_idx: (r.allele, r.impact) for r in QUERIES["split_uniform_first"](spark, str(tmp_path)).collect()}
    assert got == {i: (allele, impact) for i, (_, allele, impact) in FIRST.items()}


def test_text_of_all_leaves(spark, tmp_path):
    texts = [None, "", " ", " a ", "a\tb", "a\nb\r\nc\r", 'say "x"', '"', '""', "\\", "\\n", "\\\\t\\", "\\\t", "\\N", "#a", "'", ",", "x\0y", "\u2028\x85é漢", "null", "."]
    numbers = [None, 0.1, -0.0, float("nan"), float("inf"), float("-inf"), 1e-45]
    stamp = datetime.datetime(2020, 3, 1, 2, 3, 4, 50)
    rows = [(i, t, (numbers[i % 7], (t, i % 2 == 0)), [t, "b"], stamp, stamp, bytearray(b"\x00\xff")) for i, t in enumerate(texts)]
    schema = "i int, t string, info struct<x:float, sub:struct<deep:string, flag:boolean>>, l array<string>, at timestamp, wall timestamp_ntz, b binary"
    df = spark.createDataFrame(rows, schema).repartition(3)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        tables.write_tsv(df, path, compression)
        back = tables.read_tsv(spark, path, df.schema)
        assert back.columns == ["i", "t", "info.x", "info.sub.deep", "info.sub.flag", "l", "at", "wall", "b"]
        want = df.select("i", "t", "info.x", "info.sub.deep", "info.sub.flag", "l", "at", "wall", "b").orderBy("i").collect()
        for got, row in zip(back.orderBy("i").collect(), want, strict=True):
            assert str(tuple(got)) == str(tuple(row))


def test_import_of_all_types(spark, tmp_path):
    from strandloom.plans.importing import QUERIES

    types = ["snv ", " INDEL/SNV", "tandem_repeat", "Mnp?", "0", "a;b", "a=b", "a,b", "a\tb\r\nc", "\\", "a\\b", "\x00\x1f\x7f", "é漢", "%3b", ".", "", None]
    rows = [(i, None if i == 3 else "1", 7, "A", "C", "rs", 1.0, "PASS", (t, 0.5)) for i, t in enumerate(types)]
    schema = "variant_idx long, chr string, position int, ref string, alt string, id string, qual float, filter string, info struct<variant_type:string, cadd_phred:float>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "variants.parquet"))
    got = {r.vid: (r.gene_detail, r.cadd) for r in QUERIES["import_annovar"](spark, str(tmp_path)).collect()}
    assert got == {i: ((t or "") + ";x=1", 0.5) for i, t in enumerate(types)}


def test_long_header(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    more = "".join(f'##INFO=<ID=F{i},Number=1,Type=Integer,Description="n">\n' for i in range(1500))
    open(path, "w").write("##fileformat=VCFv4.2\n" + more + HEAD.split("\n", 1)[1] + "22\t10\t.\tA\tC\t.\t.\tDB;F1499=7;F3=a=b;F1499=8\n")
    assert len(vcf.read_header(spark, path).infos) == 1504
    row = vcf.read(spark, path, keep=["DB", "F1499", "F3", "F4"], raw=("F3",)).first()
    assert (row.info.DB, row.info.F1499, row.info.F3, row.info.F4) == (True, 7, "a=b", None)
    open(path, "w").write("##fileformat=VCFv4.2\n")
    assert vcf.import_plain(spark, path).count() == 0


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    for name, n in (("a", 2), ("b", 5), ("c", 20_000), ("d", 0), ("e", 1)):
        (tmp_path / f"{name}.vcf").write_text(HEAD + "".join(f"1\t{i + 1}\t{name}{i}\tA\tC\t.\t.\t.\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.id: r.variant_idx for r in vcf.import_plain(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [f"{name}{i}" for name, n in (("a", 2), ("b", 5), ("c", 20_000), ("e", 1)) for i in range(n)]
    assert got == {n: i + 1 for i, n in enumerate(names)}


def test_escapes_of_any_depth(spark):
    rows = [(None,), ("",), ("plain",), (r"\x5cx5cx5cx5cx5cx5cx5cx3b",), (r"\x5Cx3d\x3B",), (r"\xzz",), ("a" * 1000 + r"\x41",), (r"\x\x335c",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").coalesce(1).select(A.decode_hex(F.col("t")).alias("x")).collect()]
    assert got == [None, "", "plain", ";", "=;", r"\xzz", "a" * 1000 + "A", "5c"]


def test_keys_reach_the_scan(spark, variants, tmp_path):
    path = str(tmp_path / "source")
    variants.drop("file_idx").write.parquet(path)
    source = spark.read.parquet(path).withColumn("file_idx", F.col("load_id"))
    df = lookup.annotate(["1-100-A-C", "2-50-G-GTT,A"], source, ["score"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "PushedFilters" in line and "position" in line)
    assert "In(chr, [1,chr1" in scan and "GreaterThanOrEqual(position,100)" in scan
    # the rows that are hit are picked before any is sorted, grouped or moved
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Aggregate") < tree.index("LeftSemi")


def test_many_keys_take_the_other_way(spark, variants, monkeypatch):
    keys = ["1-100-A-C", "2-50-G-GTT,A", "9-1-A-C", "X-9-ACG-A"]
    want = [tuple(r) for r in lookup.annotate(keys, variants, [":id"]).collect()]
    monkeypatch.setattr(lookup, "MOST_BYTES", 0)
    monkeypatch.setattr(lookup, "MOST_CHROMOSOMES", 1)
    assert [tuple(r) for r in lookup.annotate(keys, variants, [":id"]).collect()] == want
    assert lookup.annotate([], variants, [":id"]).collect() == []


def test_range_sets_and_index(spark, variants):
    r = [spark.createDataFrame(x, "chr string, start int, end int") for x in ([("1", 1, 200), ("chr1", 100, 100)], [], [("X", 1, 10), ("2", 50, 50), (None, 1, 2)])]
    got = [(x.range_set, x.variant_idx, x.chr) for x in lookup.annotate_ranges(variants, r, ["score"]).orderBy("range_set", "variant_idx").collect()]
    assert got == [(0, 1, "1"), (0, 2, "1"), (2, 3, "2"), (2, 5, "X"), (2, 6, "X")]
    assert lookup.annotate_ranges(variants, []).count() == 0
    index = spark.createDataFrame([(1,), (1,), (None,), (99,)], "variant_idx long")
    assert [x.variant_idx for x in lookup.by_index(variants, index).collect()] == [1]


def test_annotated_table(spark, variants, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "u")
    variants.drop("file_idx", "info").write.parquet(path)
    lookup.write_annotated(path, variants, ["score"], root="found", out=out)
    assert spark.read.parquet(out).where("variant_idx = 2").first().found.score == 5.0 and "found" not in spark.read.parquet(path).columns
    lookup.write_annotated(path + "/", variants, {"qual": "score"}, replace=True, drop=("filter",))
    got = spark.read.parquet(path)
    assert got.count() == 7 and "filter" not in got.columns and got.where("variant_idx = 2").first().qual == 5.0
    assert not (tmp_path / "t-old").exists() and not (tmp_path / "t-new").exists()
    (tmp_path / "t-old").mkdir()
    with pytest.raises(ValueError, match="earlier run"):
        lookup.write_annotated(path, variants, ["score"])


def test_counters_of_imported_records(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    head = HEAD.replace("Format: Allele|AF|CANONICAL|SYMBOL", "Format: Allele|Consequence|IMPACT|SYMBOL")
    open(path, "w").write(head + "1\t1\t.\tA\tC\t.\t.\tCSQ=C|intron_variant&stop_gained|HIGH|G1,C|odd||G2\n1\t9\t.\tA\tC\t.\t.\t.\n")
    df = vcf.import_vep(spark, path)
    got = {(r.stat, r.category): r.n for r in stats.annotated_counters(df).collect()}
    assert got["cons_severe", "stop_gained"] == 1 and got["n_annot", "n"] == 2 and got["n_var", "n"] == 2 and got["gene_impact", "G2\r"] == 1 and got["cons_all", "odd"] == 1
    flat = {(r.stat, r.category): r.n for r in stats.counters(df, stats.annotated_records(df)).collect()}
    assert flat == got
    out = report.report(df, str(tmp_path / "a.Rmd"), "a.vcf")
    assert "barplot" in open(out).read() and "Bases per variant" in open(out).read()
    a = report.collect(stats.annotated_counters(df), "x", {"k": "1"}, stats.position_ranges(df), 10)
    b = a.merge(report.collect(stats.annotated_counters(df.where("position = 9")), "y", {"k": "2", "l": "3"}, stats.position_ranges(df.where("position = 9")), 5))
    assert b.n_variant == 3 and b.ranges == {"1": (1, 9)} and b.header == {"k": "1", "l": "3"} and b.source == "x, y" and b.bytes == 15 and b.span == 9


def test_units_of_many_variants(spark):
    e = spark.range(1, 200_001).select(F.col("id").alias("variant_idx"), F.lit("G").alias("gene"), F.lit("1").alias("chr"), F.col("id").cast("int").alias("position"))
    e = e.unionByName(e.where("variant_idx < 10")).unionByName(spark.createDataFrame([(None, "G", "1", 1)], "variant_idx long, gene string, chr string, position int"))
    m = counts.unit_members(e, ["gene"])
    assert sorted(len(r["index"]) for r in m.collect()) == [3393, 65535, 65536, 65536]
    r = counts.unit_ranges(m, ["gene"]).first()
    assert (r.n, r.chr, r.start, r.end) == (200_000, "1", 1, 200_000)
    u = counts.unit_groups(e, ["gene"]).first()
    assert u["index"] == list(range(1, 200_001)) and (u.start, u.end) == (1, 200_000)


def test_lines_that_are_no_variants(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    lines = ["1\tx\t.\tA\tC\tq\t.\t.", "1\t5", "", "\t\t\t\t\t\t\t", "1\t5\trs\tA\tC\t1e400\tPASS\tAF=a,1;;=;DB=0;AF", "1\t99999999999\t.\tA\tC\t.\t.\tDB\tGT\t0/1"]
    open(path, "w").write(HEAD + "\n".join(lines) + "\n")
    got = vcf.import_plain(spark, path).orderBy("variant_idx").collect()
    assert [(r.variant_idx, r.chr, r.position, r.ref) for r in got] == [(1, "1", None, "A"), (2, "1", 5, None), (3, "", None, ""), (4, "1", 5, "A"), (5, "1", None, "A")]
    assert got[3].info.AF == [None, 1.0] and got[3].info.DB is True and got[4].info.DB is True and got[1].info.AF is None


def test_counters_by_name(spark, variants):
    r = spark.createDataFrame(RECORDS, R)
    full = {(x.stat, x.category): x.n for x in stats.counters(variants, r).collect()}
    for only in ({"known"}, {"cons_severe"}, {"feature", "qual"}, set()):
        got = {(x.stat, x.category): x.n for x in stats.counters(variants, r, only).collect()}
        assert {k: n for k, n in got.items() if k[0] in only} == {k: n for k, n in full.items() if k[0] in only}


def test_long_ranges(spark):
    import random

    rng = random.Random(2)
    size = lookup.BIN * lookup.CELL
    edges = [0, 1, size - 1, size, size + 1, 2 * size, 3 * size - 1, 3 * size]
    rows = [(i, rng.choice(["1", "chr1", "2", None]), rng.choice(edges) + rng.choice([-1, 0, 1, 7]) if rng.random() < 0.7 else rng.randrange(4 * size)) for i in range(800)] + [(900, "1", None)]
    v = spark.createDataFrame(rows, "variant_idx long, chr string, position int").withColumns({"ref": F.lit("A"), "alt": F.lit("C"), "file_idx": F.lit(0)})
    for n in range(3):
        rs = [(rng.choice(["1", "2", "chr2"]), s, s + rng.choice([0, 5, size - 1, size, 2 * size, 3 * size + 3])) for s in (rng.choice(edges) + rng.choice([-1, 0, 1]) for _ in range(3))] + [(None, 1, 9), ("1", 5, None)]
        r = spark.createDataFrame(rs, "chr string, start int, end int")
        inside = lambda c, p: c is not None and p is not None and any(a and e is not None and a.removeprefix("chr") == c.removeprefix("chr") and b <= p <= e for a, b, e in rs)
        want = sorted(i for i, c, p in rows if inside(c, p))
        assert sorted(x.variant_idx for x in lookup.in_ranges(v, r).collect()) == want
        assert sorted(x.variant_idx for x in lookup.annotate_ranges(v, [r.limit(0), r], [":position"]).collect()) == want


def test_clashing_names_nulls_and_empty_tables(spark, variants):
    clash = variants.withColumns({n: F.lit("x") for n in ("_chr", "_row", "_i", "_at", "_v", "key", "k", "_position")})
    keys = ["1-100-A-C", "2-50-G-GTT,A", "1-100-A-C"]
    assert [r.s for r in lookup.annotate(keys, clash, {"s": ":id"}).collect()] == ["rs1", "", "rs1"]
    assert [r.s for r in lookup.annotate(keys, clash.limit(0), {"s": ":id"}).collect()] == [None] * 3
    df = spark.createDataFrame([(None, 100, "A", "C", "a"), ("1", None, "A", "C", "b"), ("1", 100, None, "C", "c"), ("1", 100, "A", "", "d"), ("chr1", 100, "A", "C", "e")], "chr string, pos int, ref string, alt string, id string")
    assert [r.id for r in lookup.annotate(df, clash, [":id"]).collect()] == [None, None, None, None, "rs1"]
    assert lookup.annotate(df.limit(0), clash, [":id"]).count() == 0
    index = spark.createDataFrame([(2, "z"), (5, "z")], "i long, variant_idx string")
    assert sorted(r.variant_idx for r in lookup.by_index(clash, index, "i").collect()) == [2, 5]
    r = spark.createDataFrame([("1", 1, 200, 9)], "chr string, start int, end int, position int")
    assert sorted(x.variant_idx for x in lookup.in_ranges(clash.withColumn("_c", F.lit("2")), r).collect()) == [1, 2]
    e = clash.withColumns({"container": F.lit(1), "index": F.lit(2), "first": F.lit(3), "gene": F.when(F.col("variant_idx") < 3, "G")})
    assert [tuple(x) for x in counts.unit_groups(e, ["gene"]).select("gene", "index", "start").collect()] == [("G", [1, 2], 100)]
    assert counts.unit_groups(e.limit(0), ["gene"], ordered=True).count() == 0 and counts.unit_members(e, ["container"]).count() == 1
    assert stats.annotated_counters(variants.limit(0)).count() == 0
