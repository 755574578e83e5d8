import math
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandloom.operators import profile
from strandloom.session import ship

COLS = {"x": "info.x", "y": "info.y"}
ACCEPTED = [("x", 0.0, 100.0, 0.1, 10.0, 15.0, 20.0), ("y", -1.0, 1.0, 0.1, 0.2, 0.3, 0.4)]


def expected(rows):
    spec, out = {a[0]: a for a in ACCEPTED}, set()
    for load in {r[0] for r in rows if r[0] is not None}:
        for k, name in enumerate("xy", 1):
            _, low, high, share, q25, _, q75 = spec[name]
            v = [r[k] for r in rows if r[0] == load]
            held = [x for x in v if x is not None]
            finite = [x for x in held if math.isfinite(x)]
            inside = [x for x in finite if low <= x <= high]
            if (len(v) - len(held)) / len(v) > share + 0.2:
                out.add((load, name, "null_rate"))
            if len(finite) < len(held):
                out.add((load, name, "not_finite"))
            if len(inside) < len(finite):
                out.add((load, name, "range"))
            if len({x + 0.0 for x in finite}) * 10 < len(finite):
                out.add((load, name, "distinct"))
            if inside and not q25 <= statistics.median(inside) <= q75:
                out.add((load, name, "shift"))
    return out


def table(rows, path, group):
    pq.write_table(pa.table({"load_id": pa.array([r[0] for r in rows], pa.int32()), "info": pa.array([{"x": r[1], "y": r[2]} for r in rows], pa.struct([("x", pa.float64()), ("y", pa.float64())])), "value": pa.array(range(len(rows)))}), path, row_group_size=group)


@pytest.mark.parametrize("seed", range(4))
def test_issues_and_footers(spark, tmp_path, seed):
    ship(spark)
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0, 500.0]

    def value(load, scale):
        if load == 3:  # constant: settled by dictionaries
            return scale
        if load == 5 and scale == 15:
            return None
        return rng.choice(odd) if rng.random() < 0.1 * (load % 3) else round(rng.gauss(scale, scale / (1 + load % 2)), 2)

    rows = [(load, value(load, 15), value(load, 0.3)) for load in sorted(rng.choices(range(8), k=400))] + [(None, 1.0, 1.0)]
    for i in range(4):  # some files hold one load each
        table([r for r in rows if r[0] == i], tmp_path / f"p{i}.parquet", 50)
    table([r for r in rows if r[0] is None or r[0] > 3], tmp_path / "rest.parquet", 70)
    df = spark.read.parquet(str(tmp_path))
    accepted = spark.createDataFrame(ACCEPTED, "column_name string, min_value double, max_value double, null_share double, q25 double, q50 double, q75 double")
    assert {tuple(r) for r in profile.issues(df, accepted, COLS).collect()} == expected(rows)
    told = {r.column_name: r for r in profile.footer_profile(df, COLS).collect()}
    for k, name in enumerate("xy", 1):
        held = [r[k] for r in rows if r[k] is not None]
        assert (told[name].n_rows, told[name].n_null) == (len(rows), len(rows) - len(held))
        plain = [x for x in held if x == x]
        assert (told[name].low, told[name].high) == (min(plain), max(plain))
        assert told[name].n_distinct == len({x + 0.0 for x in plain}) + any(x != x for x in held)


def test_settled_without_scan(spark, tmp_path):
    ship(spark)
    table([(1, 15.0, 0.3)] * 60, tmp_path / "one.parquet", 20)
    df = spark.read.parquet(str(tmp_path))
    assert profile.chunk_counts(df, COLS, "load_id").where("scanned").count() == 0
    accepted = spark.createDataFrame(ACCEPTED, "column_name string, min_value double, max_value double, null_share double, q25 double, q50 double, q75 double")
    assert {tuple(r) for r in profile.issues(df, accepted, COLS).collect()} == {(1, "x", "distinct"), (1, "y", "distinct")}
    assert profile.issues(df.limit(0).where("false"), accepted.limit(0), COLS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_distribution(spark, tmp_path, seed):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 500.0, -7.0]
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.choice(odd) if rng.random() < 0.3 else round(rng.gauss(15, 9), 1), rng.choice([0.1, 0.3, 0.3, 2.0])) for _ in range(300)]
    rows += [(5, None, 0.5), (5, float("nan"), 0.5), (6, 1.0, -1.0), (7, 1.0, 1.0), (7, 2.0, 4.0)]
    table(rows, tmp_path / "all.parquet", 50)
    accepted = spark.createDataFrame([a for a in ACCEPTED if a[0] == "x"], "column_name string, min_value double, max_value double, null_share double, q25 double, q50 double, q75 double")
    got = {(r.load_id, r.column_name): r for r in profile.profile(spark.read.parquet(str(tmp_path)), COLS, accepted=accepted).collect()}
    assert len(got) == 2 * len({r[0] for r in rows})
    for (load, name), r in got.items():
        v = sorted(x for x in (row["xy".index(name) + 1] for row in rows if row[0] == load) if x is not None and math.isfinite(x))
        assert r.n_outside == (sum(not 0 <= x <= 100 for x in v) if name == "x" else None)
        quarters = statistics.quantiles(v, n=4, method="inclusive") if len(v) > 1 else v * 3 if v else [None] * 3
        assert (r.q25, r.median, r.q75) == (pytest.approx(tuple(quarters)) if v else tuple(quarters))


def test_only_unsettled_chunks_are_read(spark, tmp_path):
    nan = float("nan")
    table([(1, 15.0, 0.3)] * 20 + [(2, 15.0, None)] * 20 + [(3, nan, -0.0)] * 20 + [(4, 1.0, 0.1), (4, 2.0, 0.1)] * 10 + [(5, 1.0, 0.1), (None, 1.0, 0.1)] * 10, tmp_path / "a.parquet", 20)
    df = spark.read.parquet(str(tmp_path))
    got = profile.chunk_counts(df, COLS, "load_id")
    assert {(r.load_id, r.name) for r in got.where("scanned").collect()} == {(4, "x"), (5, "x"), (5, "y"), (None, "x"), (None, "y")}
    counts = {(r.load_id, r.name, str(r.value)): r.n for r in profile.value_counts(df, COLS, "load_id").collect()}
    assert counts == {(1, "x", "15.0"): 20, (1, "y", "0.3"): 20, (2, "x", "15.0"): 20, (2, "y", "None"): 20, (3, "x", "nan"): 20, (3, "y", "0.0"): 20, (4, "x", "1.0"): 10, (4, "x", "2.0"): 10, (4, "y", "0.1"): 20, (5, "x", "1.0"): 10, (5, "y", "0.1"): 10, (None, "x", "1.0"): 10, (None, "y", "0.1"): 10}
    # with bounds, values on one side of the quartiles settle a chunk too
    bounds = {a[0]: (a[1], a[2], a[4], a[6]) for a in ACCEPTED}
    assert {r.load_id for r in profile.chunk_counts(df, COLS, "load_id", bounds).where("scanned").collect()} == {5, None}
    # what is no plain read is scanned by Spark: filters hold
    part = {(r.load_id, r.name, str(r.value)): r.n for r in profile.value_counts(df.where("load_id = 4"), COLS, "load_id").collect()}
    assert part == {k: n for k, n in counts.items() if k[0] == 4}


def test_files_of_which_nothing_is_settled_are_scanned(spark, tmp_path):
    table([(1, 15.0, 0.3)] * 20, tmp_path / "a.parquet", 20)
    table([(1, 15.0, 0.3), (2, 1.0, None), (2, float("nan"), 7.0)] * 5, tmp_path / "b.parquet", 20)
    df = spark.read.parquet(str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in profile.chunk_counts(df, COLS, "load_id").inputFiles()] == ["b.parquet"]
    counts = {(r.load_id, r.name, str(r.value)): r.n for r in profile.value_counts(df, COLS, "load_id").collect()}
    assert counts == {(1, "x", "15.0"): 25, (1, "y", "0.3"): 25, (2, "x", "1.0"): 5, (2, "x", "nan"): 5, (2, "y", "None"): 5, (2, "y", "7.0"): 5}


def test_files_that_lack_a_column(spark, tmp_path):
    table([(1, 15.0, 0.3), (2, 1.0, None)], tmp_path / "a.parquet", 20)
    pq.write_table(pa.table({"load_id": pa.array([1, 1], pa.int32()), "info": pa.array([{"x": 2.0}, None], pa.struct([("x", pa.float64())]))}), tmp_path / "b.parquet")
    df = spark.read.schema("load_id int, info struct<x: double, y: double>").parquet(str(tmp_path))
    counts = {(r.load_id, r.name, r.value): r.n for r in profile.value_counts(df, COLS, "load_id").collect()}
    assert counts == {(1, "x", 15.0): 1, (1, "x", 2.0): 1, (1, "x", None): 1, (2, "x", 1.0): 1, (1, "y", 0.3): 1, (1, "y", None): 2, (2, "y", None): 1}


def test_changes_and_patterns(spark, tmp_path):
    table([(1, 1.0, 0.3), (1, 3.0, 0.3), (3, 5.0, None), (3, 5.0, None)], tmp_path / "a.parquet", 20)
    got = {r.column_name: r for r in profile.changes(profile.profile(spark.read.parquet(str(tmp_path)), COLS)).collect()}
    assert (got["x"].load_id, got["x"].previous_load, got["x"].median_change, got["x"].distinct_share_change, got["x"].null_share_change) == (3, 1, 3.0, -0.5, 0.0)
    assert (got["y"].median_change, got["y"].null_share_change, got["y"].distinct_share_change) == (None, 1.0, None)
    df = spark.createDataFrame([(1, "ab"), (1, "ab\n"), (1, None), (None, "")], "load_id int, t string")
    assert {tuple(r) for r in profile.pattern_violations(df, {"t": ("t", "[a-z]+")}).collect()} == {(1, "t", 2, 1), (None, "t", 1, 1)}
