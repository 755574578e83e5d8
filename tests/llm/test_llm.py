import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import abuse, mix, percentiles, terms, tokenize
from strandloom.session import ship

VOCABULARY = os.path.join(tokenize.VOCABULARIES, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")

# ---- terms


def test_containers():
    rng = np.random.default_rng(0)
    for n, m in ((0, 3), (5, 5000), (5000, 6000), (4096, 1), (60000, 60000)):
        a, b = (np.unique(rng.integers(0, 65536, k)).astype("u2") for k in (n, m))
        both = terms.union(terms.pack(a), terms.pack(b))
        assert list(terms.unpack(both)) == list(np.union1d(a, b)) and terms.cardinality(both) == len(np.union1d(a, b))
    assert len(terms.pack(np.arange(10, dtype="u2"))) == 21 and len(terms.pack(np.arange(5000, dtype="u2"))) == 8193


def test_frequencies(spark):
    ship(spark)
    rng = random.Random(1)
    rows = [("f" if i % 3 else "g", [rng.choice(["common", "common", f"t{rng.randint(0, 40)}", "", None]) for _ in range(rng.randint(0, 4))], i * 40) for i in range(6000)] + [("f", None, 7), ("h", [None, ""], 1)]
    df = spark.createDataFrame(rows, "field string, terms array<string>, record long").withColumn("value", F.lit("clash"))
    occurrences, records, some = Counter(), Counter(), Counter()
    for f, ts, _ in rows:
        ts = [t for t in ts or [] if t]
        some[f] += bool(ts)
        occurrences.update((f, t) for t in ts)
        records.update((f, t) for t in set(ts))
    for n in (1, 7):
        got = {(r.field, r.value): r for r in terms.frequencies(df.repartition(n)).collect()}
        assert {k: (r.occurrences, r.records) for k, r in got.items()} == {k: (occurrences[k], records[k]) for k in occurrences}
        for (f, _), r in got.items():
            assert r.mark == ("rare" if r.records <= 2 else "common" if r.records / some[f] >= 0.2 else "")
    assert terms.frequencies(df.limit(0)).count() == 0


def test_same_record_in_two_partitions_counts_once(spark):
    ship(spark)
    df = spark.createDataFrame([("f", ["a"], 5), ("f", ["a", "b"], 5)], "field string, terms array<string>, record long").repartition(2)
    assert {r.value: (r.occurrences, r.records) for r in terms.frequencies(df).collect()} == {"a": (2, 1), "b": (1, 1)}


# ---- percentiles


def test_bound_and_merge(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.lognormvariate(0, 3), -rng.lognormvariate(0, 2), 0.0])) for k in "aab" for _ in range(1500)] + [("c", 5.0), ("d", None), ("e", float("nan")), ("f", float("-inf")), (None, 1.0), ("z", -0.0)]
    df = spark.createDataFrame(rows, "k string, value double").withColumn("n", F.lit("clash"))
    qs = {f"q{i}": i / 20 for i in range(21)}
    whole = percentiles.sketch(df, ["k"])
    parts = percentiles.combine(*[percentiles.sketch(df.where(c), ["k"]) for c in ("value > 1", "value <= 1", "value is null or isnan(value)")])
    got = {r.k: r for r in percentiles.percentiles(whole, ["k"], qs).collect()}
    again = {r.k: r for r in percentiles.percentiles(parts, ["k"], qs).collect()}
    assert got == again and set(got) == {"a", "b", "c", None, "z"}
    for k, r in got.items():
        v = sorted(x for g, x in rows if g == k)
        assert r.n == len(v)
        for name, q in qs.items():
            true = v[math.floor(q * (len(v) - 1))]
            assert abs(r[name] - true) <= percentiles.ACCURACY * abs(true) * (1 + 1e-9)
    assert percentiles.percentiles(percentiles.sketch(df.limit(0), ["k"]), ["k"], qs).count() == 0


# ---- tokenizer


@pytest.fixture(scope="module")
def tool():
    return tokenize.encoder()


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n\t'sé日ा̀\U0001f600‍0١²", max_size=80))
def test_like_the_public_library(tool, text):
    import tiktoken

    want = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=tool.ranks, special_tokens={}).encode_ordinary(text)
    assert tool.encode(text) == want
    assert b"".join(tool.bytes_of[i] for i in want) == text.encode()


@needs_vocabulary
def test_merge_order(tool):
    def slow(data):
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            ranked = [(tool.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            r, i = min(ranked)
            if r == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [tool.ranks[p] for p in parts]

    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice("abeinorst ATG") for _ in range(rng.randint(0, 60))).encode()
        assert tool.merge(data) == slow(data)
    assert len(tool.merge(b"a" * 50_000)) < 50_000


@needs_vocabulary
def test_encode_rows(spark, tool):
    ship(spark)
    texts = ["Hello  world", "", None, "<|endoftext|>", " " * 5000, "日本語 text", "x" * 200_000, "Hello  world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df).collect()}
    assert got == {i: tool.encode(t) for i, t in enumerate(texts)} and got[1] == got[2] == [] and len(got[3]) > 1
    assert tokenize.encode(df.limit(0)).count() == 0
    counted = {r.doc_id: r.n_tokens for r in tokenize.count_tokens(df, ["doc_id"]).collect()}
    assert counted == {i: len(v) for i, v in got.items()}


def test_rank_queue():
    rng, q, left = random.Random(4), tokenize.RankQueue(), []
    for _ in range(3000):
        if left and rng.random() < 0.4:
            rank, positions = q.pop()
            assert rank == min(left)[0] and sorted(positions) == sorted(p for r, p in left if r == rank)
            left = [x for x in left if x[0] != rank]
        else:
            left.append((rng.randrange(50_256), rng.randrange(100)))
            q.push(*left[-1])


# ---- mixing


def test_fill():
    got = mix.fill(100, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 1000, "b": 5, "c": 1000, "d": 9}, {"a": 1, "b": 2, "c": 1, "d": 5})
    assert got == pytest.approx({"a": 90 * 5 / 7, "b": 10, "c": 90 * 2 / 7, "d": 0})
    assert sum(mix.fill(1e9, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, {"a": 2, "b": 3}).values()) == 80
    assert mix.fill(10, {"a": 1.0}, {"a": 0}, {"a": 2}) == {"a": 0}


def test_choose(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else "small", rng.randint(1, 50)) for i in range(3000)] + [(9001, None, 5), (9002, "small", 0), (9003, "other", 5)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.7, 3), ("none", 0.1, 4), ("null", None, None), ("small", 0.1, 9)], "source string, target_share double, max_repeats int")
    planned = mix.plan(sized, targets)
    chosen = mix.choose(sized, planned)
    got = chosen.collect()
    assert {(r.doc_id, r.repeats) for r in got} == {(r.doc_id, r.repeats) for r in mix.choose(sized.repartition(5), planned).collect()}
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.repeats <= (1 if r.source == "big" else 3) and r.n_tokens > 0 for r in got)
    share = {r.source: r.actual_share for r in mix.shares(sized, planned).collect()}
    assert share["small"] == pytest.approx(0.7 / 0.9, abs=0.002) and share["big"] == pytest.approx(0.2 / 0.9, abs=0.002) and share["none"] == 0
    clamped = mix.plan(sized, targets, total_tokens=10**9)
    assert {r.source: r.epochs for r in clamped.collect()} == {"big": 1, "small": 3, "none": 0, "null": 0}
    assert mix.shares(sized, clamped).where("source = 'small'").first().most_repeats == 3
    assert mix.choose(sized.limit(0), mix.plan(sized.limit(0), targets)).count() == 0


def test_clamped_mix(spark, tmp_path):
    from strandloom.llm import queries

    rows = [(i, f"{i} some words of a text", "big") for i in range(300)] + [(900 + i, "few words", "tiny") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.5, 4), ("tiny", 0.5, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    got = {r.source: r for r in queries.QUERIES["p8_shares_all"](spark, str(tmp_path)).collect()}
    have, tiny = sum(r.available for r in got.values()), got["tiny"].available
    assert (got["tiny"].tokens, got["tiny"].most_repeats, got["tiny"].epochs) == (2 * tiny, 2, 2.0)
    assert got["big"].epochs == pytest.approx((have - 2 * tiny) / got["big"].available)
    assert sum(r.tokens for r in got.values()) == pytest.approx(have, abs=10)
    chosen = queries.QUERIES["p8_mix_all"](spark, str(tmp_path)).collect()
    assert sum(r.n_tokens * r.repeats for r in chosen) == sum(r.tokens for r in got.values())


# ---- abusive content


def test_words():
    def ids(t):
        w, _, i, _ = abuse.words_of([t])
        return i[w].tolist()

    same = ["you idiot", "YOU  IDIOT!", "you 1d10t", "you i-d-i-o-t,", "you i d i o t .", "you idi​ot", "yоu idiot", "you idiiiiot", "you idíot"]
    assert all(ids(t) == ids(same[0]) for t in same), [ids(t) for t in same]
    assert len(ids("外国人")) == 3 and ids("") == [] and len(ids("1 22 333 x")) == 2
    assert len(ids("zj@NcP;&B%)BG_U?r^bcB2^LvH|aUi0z}VBeg_Mir;id>aN>caI#r")) == 1


FILL = "the parser reads every table before writing rows again while this loader keeps columns in order and returns counts from all files when nothing changed".split()


def _plainly(w, text):
    """The score by its definition: every word read by itself, every window pooled by itself."""
    word, doc, ids, grams = abuse.words_of([text])
    p, n, hid = abuse._project(w, abuse.embed(w, ids, grams)).astype("f8"), len(word), abuse.HIDDEN

    def step(x, u, h):
        z, r = (1 / (1 + np.exp(-(x[i * hid : (i + 1) * hid] + h @ u[:, i * hid : (i + 1) * hid]))) for i in (0, 1))
        return (1 - z) * np.tanh(x[2 * hid :] + r * (h @ u[:, 2 * hid :])) + z * h

    f, b = np.zeros((n, hid)), np.zeros((n, hid))
    for low in range(0, n, abuse.BLOCK):
        high, h = min(n, low + abuse.BLOCK), np.zeros(hid)
        for t in range(max(0, low - abuse.CONTEXT), high):
            h = step(p[word[t], : 3 * hid], w["fore"], h)
            f[t] = h if t >= low else f[t]
        h = np.zeros(hid)
        for t in range(min(n, high + abuse.CONTEXT) - 1, low - 1, -1):
            h = step(p[word[t], 3 * hid :], w["back"], h)
            b[t] = h if t < high else b[t]
    both, best = np.concatenate([f, b], 1), -np.inf
    for s in range(max(1, n - abuse.WINDOW + 1)):
        x = both[s : s + abuse.WINDOW]
        a = np.exp(x @ w["attend"])
        best = max(best, float(a @ (x @ w["out"]) / a.sum() + w["out_bias"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_by_definition():
    w, rng = abuse.load(), random.Random(3)
    texts = [" ".join(rng.choice([*FILL, "you", "stupid", "idiot"]) for _ in range(n)) for n in (1, 2, 31, 32, 33, 111, 112, 113, 128, 129, 240, 300)]
    got = abuse.scores(w, [*texts, "", None, "?!"])
    assert got[:-3] == pytest.approx([_plainly(w, t) for t in texts], rel=1e-3) and (got[-3:] == 0).all()


def test_long_words_are_read_in_pieces():
    word, _, ids, (g, offset) = abuse.words_of(["x" + "abcdefghijklmnopqrstuvwxyz" * 3])
    assert len(word) == 1 + -(-(79 - abuse.PIECE) // abuse.STEP) and set(np.diff(offset)) == {abuse.PIECE}
    assert len(abuse.words_of(["abcdefghijklmnopqrstuvw"])[0]) == 1
    # no character is out of reach, however long the word
    base = "abcdefghijklmnopqrstuvwxyz" * 400
    assert abuse.words_of([base])[0].size > 1000 and len(abuse.words_of([base + "quq"])[2]) > len(abuse.words_of([base])[2])


@pytest.mark.parametrize("sentence", ["裸の写真を送れば承認する。", "你这个白痴，滚出去。", "外地人都是贼，统统赶走。", "+# Пришли голые фото, тогда приму."])
def test_found_at_every_offset(sentence):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(FILL) for _ in range(40 + k)) + "\n" + sentence + "\n" + " ".join(rng.choice(FILL) for _ in range(60)) for k in range(20)]
    assert min(abuse.scores(abuse.load(), texts)) >= abuse.THRESHOLD


def test_gradient():
    texts = ["you are a bad one", "this is fine then and some more words", "short"]
    word, doc, ids, grams = abuse.words_of(texts)
    w = {k: v.astype("f8") for k, v in abuse.new_weights(2).items()}
    begin, count, _ = abuse.places(doc, 3)
    index, length = abuse.windows_of(word, begin, count, begin, len(ids))
    x = abuse.embed(w, ids, grams).astype("f8")

    def loss(w):
        return float(abuse.forward(w, abuse._project(w, x), index, length).astype("f8") @ np.array([1.0, -2.0, 0.5]))

    _, cache = abuse.forward(w, abuse._project(w, x), index, length, keep=True)
    g, dp = abuse._backward(w, cache, index, length, np.array([1.0, -2.0, 0.5]), len(ids))
    g["input"], g["bias"] = x.T @ dp, dp.sum(0)
    rng = np.random.default_rng(3)
    for name in ("input", "bias", "fore", "back", "attend", "out", "out_bias"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            kept, out = w[name][at], []
            for e in (1e-2, -1e-2):
                w[name][at] = kept + e
                out.append(loss(w))
            w[name][at] = kept
            assert (out[0] - out[1]) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-3), name


def test_training_separates():
    rng = random.Random(6)
    plain = ["loop table index of the old row", "we changed the script and the test", "refactor this header now"]
    bad = ["you are a stupid fool", "go away you fool", "what a stupid person you are"]
    texts, share = [], []
    for i in range(240):
        filler = " ".join(rng.choice(plain) for _ in range(rng.randint(1, 12)))
        hit = i % 3 == 0
        texts.append(f"{filler} {rng.choice(bad)} {filler}" if hit else filler)
        share.append(float(hit))
    w = abuse.train(texts[:180], np.array(share[:180]), rounds=150, rate=1e-2)
    p = abuse.scores(w, texts[180:])
    assert np.mean((p >= 0.5) == np.array(share[180:])) > 0.95


def test_shipped_weights(spark):
    ship(spark)
    texts = ["Shut your mouth, you 1d10t. Nobody likes you.", "Fix the loop that kills the idle worker", "", None, "   ", "word " * 30_000 + "go away, you worthless fool", "Shut your mouth, you 1d10t. Nobody likes you."]
    df = spark.createDataFrame([(i, t, None if i else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    got = [r.score for r in abuse.score(df, ["doc_id"]).orderBy("doc_id").collect()]
    assert got[0] > 0.9 and got[1] < 0.5 and got[2] == got[3] == got[4] == 0 and got[5] > 0.5 and got[6] == pytest.approx(got[0], abs=1e-5)
    rates = {r.source: (r.documents, r.found) for r in abuse.rates(abuse.score(df, ["doc_id", "source"])).collect()}
    assert rates == {"s": (1, 1), "": (6, 2)}
    assert abuse.score(df.limit(0), ["doc_id"]).count() == 0


# ---- queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p5_found", "p5_frequencies", "p6_percentiles", "p6_exact_bound", "p7_ids", "p8_mix", "p8_shares", "p8_plan_chars", "p9_found", "p9_scores", "p9_rates"])
def test_query(spark, name):
    import duckdb
    from compare import rows_of

    from strandloom.llm import queries

    df = queries.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in queries.SQL:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f.removesuffix('.parquet')} as from read_parquet('{DATA}/{f}{'/*.parquet' if os.path.isdir(f'{DATA}/{f}') else ''}')")
        cur = c.execute(queries.SQL[name])
        assert got == rows_of([x[0] for x in cur.description], cur.fetchall())
