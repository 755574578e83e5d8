from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import packed

CASES = {
    "A|x,B|y": ["A|x", "B|y"],
    ' A|x ; B|y\nC\tD ': ["A|x", "B|y", "C", "D"],
    '"A|x,1",B': ["A|x,1", "B"],
    "'A|x';'B|y'": ["A|x", "B|y"],
    '"say ""x"", y",Z': ['say "x", y', "Z"],
    'A|"p.X, or p.Y"|,B': ['A|"p.X, or p.Y"|', "B"],
    '"x, y"|b,C': ['"x, y"|b', "C"],
    ",,A,, ,B,": ["A", "B"],
    '""': [],
    "": [],
    ".": [],
    "  ": [],
    '"A,B': ['"A', "B"],  # never closes: read as bare
    '"A"x,B': ['"A"x', "B"],  # closes too early
    "5'UTR,3'UTR": ["5'UTR", "3'UTR"],
    "A,A,A": ["A", "A", "A"],
}


def reference(text: str, packing: packed.Packing) -> list[str]:
    node, out, i = packing.value(), [], 0
    while i < len(text):
        e = node.match(text, i)
        if e is None or e == i:
            i += 1
        else:
            out.append(text[i:e])
            i = e
    return out


def test_cases(spark):
    rows = [(i, k) for i, k in enumerate([*CASES, None])]
    got = spark.createDataFrame(rows, "i int, x string").select("x", packed.values(F.col("x")).alias("v")).collect()
    for r in got:
        assert r.v == ([] if r.x is None else CASES[r.x]), r.x


def test_positions_flags_and_extra_columns(spark):
    df = spark.createDataFrame([(1, '"A,B', "c", 5), (1, '"A,B', "c", 5), (2, None, "d", 6), (None, "x", "e", 7)], "row_id long, f string, value string, pos int")
    got = [tuple(r) for r in packed.split_rows(df, {"F": F.col("f")}, "row_id").orderBy("row_id", "pos").collect()]
    assert got == [("F", None, 1, "x", False, ""), *[("F", 1, 1, '"A', False, "malformed_quote")] * 2, *[("F", 1, 2, "B", False, "")] * 2]
    assert packed.split_rows(df.limit(0), {"F": F.col("f")}, "row_id").count() == 0


def test_flags_follow_the_grammar(spark):
    cases = {
        '"A|x,1"': ("A|x,1", True, ""), '"A|x': ('"A|x', False, "malformed_quote"), 'A|"x|y"|z': ('A|"x|y"|z', False, ""), 'A|"x|y': ('A|"x|y', False, "malformed_quote"),
        'A|"x"y|z': ('A|"x"y|z', False, "malformed_quote"), "5'UTR|3'": ("5'UTR|3'", False, ""), 'A|"say ""x"""': ('A|"say ""x"""', False, ""), "'a\"b'": ('a"b', True, ""), '|"x" |': ('|"x" |', False, ""),
    }
    got = spark.createDataFrame([(k,) for k in cases], "x string").coalesce(1).select("x", packed.flagged(F.col("x")).alias("v")).collect()
    assert {r.x: tuple(r.v[0]) for r in got} == cases
    got = spark.createDataFrame([('"a',), ("'a'",), ('a"',)], "x string").coalesce(1).select(packed.flagged(F.col("x"), packed.TERMS).alias("v")).collect()
    assert [r.v[0].error for r in got] == ["malformed_quote", "", ""]


def test_long(spark):
    text = ",".join(["A|" + "x" * 50] * 20000) + ',"' + '""' * 50000 + '"'
    got = spark.createDataFrame([(1, text)], "i long, x string").select(packed.values(F.col("x")).alias("v")).first().v
    assert len(got) == 20001 and got[-1] == '"' * 50000


def test_brackets(spark):
    p = packed.Packing(brackets=("()", "[]"))
    got = spark.createDataFrame([("(a,b),[c;d],(e",)], "x string").select(packed.values(F.col("x"), p).alias("v")).first().v
    assert got == ["(a,b)", "[c;d]", "(e"]


def test_terms(spark):
    df = spark.createDataFrame([("a, b",), ('"a";"b"',), ("a / b|c&d",), ("'a','b'",), ("a",)], "x string")
    assert [r.v for r in df.select(packed.values(F.col("x"), packed.TERMS).alias("v")).collect()] == [["a", "b"], ["a", "b"], ["a", "b", "c", "d"], ["a", "b"], ["a"]]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab|,; \"'\n([", max_size=14), min_size=40, max_size=60))
def test_jvm_and_interpreter_agree(spark, texts):
    for p in (packed.RECORDS, packed.TERMS, packed.Packing(brackets=("()", "[]"))):
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        for r in df.select("x", F.regexp_extract_all("x", F.lit(p.value().java()), F.lit(0)).alias("v")).collect():
            assert r.v == reference(r.x, p), r.x
