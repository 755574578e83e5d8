from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandloom.operators import drift, rejects

T = datetime(2024, 1, 1)
HEADER = "header_id long, feed string, file_id int, file_seq int, ordinal int, column_name string, type string, essential boolean, description string, delivered_at timestamp, extra int"
BASE = [("variant_vcf", "character"), ("chromosome", "character"), ("position", "integer"), ("ref_vcf", "character"), ("alt_vcf", "character")]


def header(spark, files):
    """files: {file_id: [(name, type, description)...]} of one feed in order."""
    rows, k = [], 0
    for seq, (f, cols) in enumerate(files.items(), 1):
        for i, (n, t, d) in enumerate([*[(n, t, n) for n, t in BASE], *cols], 1):
            k += 1
            rows.append((k, "feed", f, seq, i, n, t, True, d, T, 0))
    return spark.createDataFrame(rows, HEADER), rows


def log(spark, files):
    h, _ = header(spark, files)
    return sorted(tuple(r)[2:] for r in drift.changes(rejects.header_columns(h)).collect())


def test_changes(spark):
    got = log(spark, {
        1: [("a", "numeric", "Score of a"), ("b", "integer", "Count  of b."), ("c", "character", "Text"), ("g", "numeric", None)],
        2: [("A", " Numeric", "score of a."), ("b", "character", "count of b"), ("d", "logical", "New"), ("h", "numeric", None)],
        3: [("b", "CHARACTER ", "reworded"), ("A", "numeric", "score of a"), ("d", "logical", "New"), ("h", "numeric", "told now")],
    })
    assert got == [(2, "added", "", "d"), (2, "added", "", "h"), (2, "removed", "c", ""), (2, "removed", "g", ""), (2, "renamed", "a", "A"), (2, "retyped", "b", "b")]


def test_log_is_in_order(spark):
    h, _ = header(spark, {10: [("a", "numeric", "x")], 3: [("b", "numeric", "y")], 7: [("c", "numeric", "z")]})
    none = spark.createDataFrame([], "release int, ordinal int, name string, type string, uniform string, description string, released_at timestamp")
    got = [(r.file_id, r.change) for r in drift.change_log(h, none).collect()]
    assert got == [(3, "added"), (3, "removed"), (7, "added"), (7, "removed")]


def test_one_file_holds_nearly_all_lines(spark):
    h, _ = header(spark, {f: [("s", "numeric", "x")] for f in range(1, 40)})
    lines = spark.range(4000).select(F.col("id").alias("line_id"), F.when(F.col("id") < 3600, 1).otherwise(2 + F.col("id") % 38).cast("int").alias("file_id"), F.lit("1-5-A-C,1,5,A,C,1").alias("raw"))
    shares = rejects.PARTS * spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in rejects.hot_files(lines).collect()] == [(1, -(-3600 * shares // 4000))]
    laid = rejects.with_layout(lines, rejects.layouts(h), rejects.hot_files(lines))
    assert laid.count() == 4000 and laid.where("names is null").count() == 0
    got = drift.consistent_lines(lines, h)
    assert got.where("s = 1").count() == 4000
    # no task of the join gets much more than its share of the hot file
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and rejects.hot_files(lines.limit(0)).count() == 0


def test_first_file_and_empty(spark):
    assert log(spark, {1: [("a", "numeric", "x")]}) == []
    h, _ = header(spark, {1: []})
    assert drift.changes(rejects.header_columns(h.limit(0))).count() == 0


def test_header_rejects_and_twice_delivered(spark):
    h, rows = header(spark, {1: [("a", "numeric", "x")]})
    odd = [(90, 'q"a', "numeric"), (91, None, "numeric"), (92, "", "numeric"), (93, "a;b", "numeric"), (94, "ok", "tbd"), (95, "ok", None), (96, '"ok"', "numeric")]
    more = [(i, "feed", 1, 1, 0, n, t, None, None, T, 0) for i, n, t in odd] + [(97, *rows[0][1:])]
    h = h.unionByName(spark.createDataFrame(more, HEADER))
    got = {r.row_id: r.reason for r in rejects.header_rejects(h).collect()}
    assert got == {90: "quoting", **dict.fromkeys(range(91, 97), "bad_value")}
    assert rejects.header_columns(h).count() == 6


LINES = {
    "1-5-A-C,1,5,A,C,1.5e3": None,
    "chrX_5_a_c,X,5,A,C,": None,
    '"1:5:A:C",chr1,5,A,C,"NA"': None,
    "1-5-A-C,1,5,A,C": "column_count",
    "": "column_count",
    None: "column_count",
    '1-5-A-C,1,5,A,C,"1': "quoting",
    '1-5-A-C,1,5,A,C,1"2': "quoting",
    '1-5-A-C,1,5,A,C,"1" ': "quoting",
    "1-5-A-C,1,5,A,C,12%": "bad_value",
    "1-5-A-C,23,5,A,C,1": "bad_value",
    "1-5-A-C,1,6,A,C,1": "bad_value",
    "1-0-A-C,1,0,A,C,1": "bad_value",
    "1-99999999999-A-C,1,99999999999,A,C,1": "bad_value",
    "1-5-A-,1,5,A,,1": "bad_value",
    "1-5-A-C-,1,5,A,C,1": "bad_value",
}


def test_lines(spark):
    h, _ = header(spark, {1: [("s", "numeric", "x")]})
    lines = spark.createDataFrame([(i, 1, i, raw, T, "x") for i, raw in enumerate(LINES)] + [(99, 7, 1, "a", T, "x")], "line_id long, file_id int, line_no int, raw string, received_at timestamp, names string")
    lines = lines.withColumnRenamed("names", "extra")
    got = {r.row_id: r.reason for r in rejects.line_rejects(lines, h).collect()}
    assert got == {i: w for i, w in enumerate(LINES.values()) if w} | {99: "column_count"}
    loaded = {r.line_id: r.fields for r in rejects.load_lines(lines, h).collect()}
    assert set(loaded) == {0, 1, 2} and loaded[2][-1] == "NA"
    assert rejects.line_rejects(lines.limit(0), h).count() == 0
    assert rejects.line_rejects(lines, h.limit(0)).count() == len(LINES) + 1


def test_union_schema_and_cast(spark):
    h, _ = header(spark, {1: [("a", "integer", "Score"), ("f", "logical", "Flag")], 2: [("b", "numeric", "score."), ("f", "logical", "flag")]})
    lines = spark.createDataFrame([(1, 1, 1, "1-5-A-C,1,5,A,C,7,TRUE", T), (2, 2, 1, "1-5-A-C,1,5,A,C,.5,NA", T)], "line_id long, file_id int, line_no int, raw string, received_at timestamp")
    got = drift.consistent_lines(lines, h).orderBy("line_id")
    assert dict(got.dtypes)["a"] == "double" and dict(got.dtypes)["f"] == "boolean"
    assert [(r.a, r.f) for r in got.collect()] == [(7.0, True), (0.5, None)]


@pytest.mark.parametrize("text,want", [("  A  b. ", "a b"), (None, ""), ("x", "x")])
def test_sense(spark, text, want):
    assert spark.range(1).select(drift.sense(F.lit(text).cast("string")).alias("s")).first().s == want
