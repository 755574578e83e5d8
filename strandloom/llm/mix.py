"""Mixing sources to target weights by capped water-filling.

Sizes are tokens.  Every source gets its weight of the total; a source that would need more than its allowed repetitions is
clamped there, and what it leaves is spread over the others in proportion to their weights, until nothing is over its cap.
A source used e times then gives every document floor(e) times and, by a seeded order, as many documents once more as make
up the fraction: the order is cut into 4096 slots by hash, whole slots are taken from per-slot sums, and only documents of the
one slot at the cut are ranked, so that no source, however large, is sorted in one task.

Defined cases: sources without a target are not used; targets without documents, with a null or negative share, or with
no repetitions get nothing and their share is spread; documents with a null source or without tokens are never chosen;
several targets for one source: the one with the largest share stands; nothing feasible gives shares of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.tokenize import VOCABULARIES, count_tokens
from strandloom.session import cut

SLOTS = 4096
SEED = 17
#: Sources of a mix; their plan is made on the driver.
MAX_SOURCES = 10_000


def fill(total: float, weights: dict[str, float], sizes: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Tokens of each source: weights of total, none above caps * sizes."""
    most = {s: max(0.0, caps[s] * sizes[s]) for s in weights}
    out = dict.fromkeys(weights, 0.0)
    open_, left = {s for s in weights if weights[s] > 0 and most[s] > 0}, float(total)
    while open_ and left > 0:
        scale = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * scale >= most[s]}
        if not over:
            for s in open_:
                out[s] = weights[s] * scale
            break
        for s in over:
            out[s] = most[s]
            left -= most[s]
        open_ -= over
    return out


def feasible(weights: dict[str, float], sizes: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total, up to all there is, at which no source with tokens is over its cap."""
    some = [s for s in weights if weights[s] > 0 and caps[s] * sizes[s] > 0]
    share = sum(weights[s] for s in some)
    return min([sum(sizes[s] for s in some), *(caps[s] * sizes[s] * share / weights[s] for s in some)])


def plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, available, wanted (tokens allotted), epochs.

    Without total_tokens the mix is the largest that gives every source with documents its share (that of the others spread)
    and is no larger than all documents of the sources with a target; a larger total clamps sources at their caps."""
    spark = sized.sparkSession
    one = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = one.where("source is not null").join(have, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weights = {r.source: max(0.0, r.target_share or 0.0) for r in rows}
    sizes = {r.source: float(r.available or 0) for r in rows}
    caps = {r.source: float(r.max_repeats or 0) for r in rows}
    got = fill(total_tokens or feasible(weights, sizes, caps), weights, sizes, caps)
    data = [(r.source, weights[r.source], int(caps[r.source]), int(sizes[r.source]), got[r.source], got[r.source] / sizes[r.source] if sizes[r.source] else 0.0) for r in rows]
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int, available bigint, wanted double, epochs double")


def sizes_of(documents: DataFrame, targets: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, source, n_tokens) of documents whose source has a target, written once to shared storage: sums, the cut and
    the choice all read it."""
    wanted = targets.where("source is not null").select("source").distinct()
    return cut(count_tokens(documents.join(wanted, "source", "left_semi"), ["doc_id", "source"], folder=folder))


def choose(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents of the mix."""
    # the plan has one row per source; its join is hot on the largest source, so it goes in as a literal map instead
    epochs = {r.source: r.epochs for r in planned.select("source", "epochs").collect() if r.epochs > 0}
    if not epochs:
        return sized.where("false").select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"))
    of = F.element_at(F.create_map(*[x for s, e in sorted(epochs.items()) for x in (F.lit(s), F.lit(e))]), F.col("source"))
    h = F.xxhash64("doc_id", F.lit(seed))
    docs = sized.where(F.col("source").isin(*epochs) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens", h.alias("h"), F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot"), of.alias("epochs"))
    whole = F.floor("epochs")
    # tokens that the fraction asks for, slot by slot
    slots = docs.groupBy("source", "slot", "epochs").agg(F.sum("n_tokens").alias("tokens"))
    by = Window.partitionBy("source")
    slots = slots.withColumn("need", F.sum("tokens").over(by) * (F.col("epochs") - whole)).withColumn("before", F.sum("tokens").over(by.orderBy("slot")) - F.col("tokens"))
    at = slots.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("tokens") >= F.col("need")))
    cuts = {r.source: (r.slot, float(r.need - r.before)) for r in at.select("source", "slot", "need", "before").collect()}  # one slot a source
    # a source without a cut slot takes no fraction at all or, where the need ends with a slot, all slots up to it
    for s in epochs.keys() - cuts.keys():
        cuts[s] = (0 if epochs[s] == int(epochs[s]) else SLOTS, 0.0)
    of_source = lambda i: F.element_at(F.create_map(*[x for s, c in sorted(cuts.items()) for x in (F.lit(s), F.lit(c[i]))]), F.col("source"))
    docs = docs.withColumn("cut", of_source(0)).withColumn("rest", of_source(1))
    edge = docs.where("slot = cut")
    ranked = edge.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    # a document goes in where more than half of it is asked for
    ranked = ranked.withColumn("extra", F.when(F.col("before") + F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)).drop("before")
    sure = docs.where("slot <> cut").withColumn("extra", F.when(F.col("slot") < F.col("cut"), 1).otherwise(0))
    repeats = (whole + F.col("extra")).cast("int")
    return sure.unionByName(ranked).select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per target: what was asked for and what was reached."""
    got = choose(sized, planned, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    total = F.sum("tokens").over(Window.partitionBy())
    return planned.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"]).select(
        "source", "target_share", "max_repeats", "available", "epochs", "tokens", "documents", "most_repeats", F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share")
    )
