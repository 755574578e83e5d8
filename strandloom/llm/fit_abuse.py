"""Fit the weights of ``abuse`` to labelled documents, and measure them on others.

    python -m strandloom.llm.fit_abuse FOLDER...           fits and writes the weights, then measures
    python -m strandloom.llm.fit_abuse measure FOLDER...   measures only

Each folder holds documents.parquet and review_labels.parquet.  A fifth of the documents, by a hash of their text so that
copies stay together, is held out: nothing of it is fitted, neither votes nor unlabelled texts, and ``measure`` reads
nothing else.  Seeds are fixed: the same folders give the same weights.

Raters err, so votes are first held against models that have not seen them (in four folds): positive votes with a low score
and negative ones with a high score are set aside.  TEACHERS networks fitted to the rest hear those again and score
unlabelled documents; the ones on which they agree on average join the next fit of each, and what those agree on the last fit of the
first, which is kept.  Positive votes that none of them understood are tried once more, for wordings that only few texts have.  Bounds: at most LABELLED
labelled, UNLABELLED unlabelled and 3 / 2 PSEUDO agreed documents, each of them whole.
"""

from __future__ import annotations

import os
import sys
import time
import zlib

import numpy as np

from strandloom.llm import abuse

LABELLED, UNLABELLED, PSEUDO = 8_000, 60_000, 8_000
TEACHERS = 4
POSITIVE = ("abusive", "hateful", "sexual")


def held_out(text: str) -> bool:
    return zlib.crc32(text.encode("utf-8", "replace")) % 5 == 0


def labelled(folder: str, held: bool):
    """(texts, share of positive votes, number of votes, unlabelled texts) of a folder, held out or not."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    docs = {d: t for d, t in zip(*[c.to_pylist() for c in table.columns]) if t and held_out(t) == held}
    votes: dict[int, list[float]] = {}
    table = pq.read_table(f"{folder}/review_labels.parquet", columns=["doc_id", "label"])
    for d, label in zip(*[c.to_pylist() for c in table.columns]):
        if label is not None and d in docs:
            votes.setdefault(d, []).append(float(label in POSITIVE))
    ids = sorted(votes)
    return [docs[d] for d in ids], np.array([np.mean(votes[d]) for d in ids], "f4"), np.array([len(votes[d]) for d in ids]), [docs[d] for d in sorted(docs) if d not in votes]


def all_scores(w, texts: list[str], size: int = 2000) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[abuse.scores(w, texts[s : s + size]) for s in range(0, len(texts), size)]])


def _each(fn, jobs: list) -> list:
    """Results of jobs that run in processes of their own."""
    from concurrent.futures import ProcessPoolExecutor
    from multiprocessing import get_context

    with ProcessPoolExecutor(TEACHERS, mp_context=get_context("spawn")) as pool:
        return list(pool.map(fn, jobs))


def _fold(args) -> np.ndarray:
    texts, share, fold, k, rounds = args
    w = abuse.train([t for t, h in zip(texts, fold) if h != k], share[fold != k], seed=k + 1, rounds=rounds)
    return all_scores(w, [t for t, h in zip(texts, fold) if h == k])


def clean(texts: list[str], share: np.ndarray, rounds: int, folds: int = 4) -> np.ndarray:
    """Which votes stand."""
    fold = np.arange(len(texts)) % folds
    seen = np.zeros(len(texts))
    for k, got in enumerate(_each(_fold, [(texts, share, fold, k, rounds) for k in range(folds)])):
        seen[fold == k] = got
    return np.where(share >= 0.5, seen >= 0.3, np.where(share > 0, False, seen < 0.7))


def _teacher(args) -> tuple[dict, np.ndarray]:
    """A network fitted to texts, or taken further with some more, and its scores of others."""
    texts, share, others, seed, rounds, start = args
    w = abuse.train(texts, share, seed=seed, rounds=rounds, rate=2e-3 if start else 4e-3, start=start)
    return w, all_scores(w, others)


def _agreed(scores: np.ndarray, texts: list[str], rng, say, most: int = PSEUDO) -> tuple[list[str], np.ndarray]:
    """Texts that the teachers find, or do not, on average and clearly."""
    yes, no = np.flatnonzero(scores.mean(0) > 0.7), np.flatnonzero(scores.mean(0) < 0.08)
    say("unlabelled", len(texts), "found", len(yes), "not found", len(no))
    pick = np.concatenate([yes[: most // 2], rng.permutation(no)[: most - min(len(yes), most // 2)]])
    return [texts[i] for i in pick], np.isin(pick, yes).astype("f4")


def fit(folders: list[str], say=print) -> dict[str, np.ndarray]:
    parts = [labelled(f, False) for f in folders]
    every = [t for p in parts for t in p[0]]
    votes = np.concatenate([p[1] for p in parts])
    rng = np.random.default_rng(5)
    order = rng.permutation(len(every))[:LABELLED]
    every, votes = [every[i] for i in order], votes[order]
    rest = [t for p in parts for t in p[3]]
    rest = [rest[i] for i in rng.permutation(len(rest))[:UNLABELLED]]
    ok = clean(every, votes, 12)
    say("votes", len(every), "positive", int((votes >= 0.5).sum()), "standing", int(ok.sum()), "positive", int((ok & (votes >= 0.5)).sum()))
    models: list = [None] * TEACHERS
    texts, share = [t for t, k in zip(every, ok) if k], (votes[ok] >= 0.5).astype("f4")
    for generation, rounds in ((0, 18), (1, 8)):
        got = _each(_teacher, [(texts, share, every + rest, 10 * generation + k + 3, rounds, models[k]) for k in range(TEACHERS)])
        models, scores = [g[0] for g in got], np.stack([g[1] for g in got])
        of_votes = scores[:, : len(every)].mean(0)
        # votes are heard again: a positive one stands where the teachers find it possible, a negative one where they do not object
        ok = np.where(votes > 0.5, of_votes >= 0.3 - 0.15 * generation, np.where(votes == 0, of_votes < 0.8, of_votes > 0.9))
        more, verdict = _agreed(scores[:, len(every) :], rest, rng, say)
        texts, share = [t for t, k in zip(every, ok) if k] + more, np.concatenate([(votes[ok] >= 0.5).astype("f4"), verdict])
        order = rng.permutation(len(texts))
        texts, share = [texts[i] for i in order], share[order]
        say("votes standing", int(ok.sum()), "positive", int((ok & (votes >= 0.5)).sum()))
    # positive votes that nobody understood may be of rare wordings: they are tried at half trust, and those stand in which a
    # single line explains the vote, as no line of an ordinary text can
    aside = np.flatnonzero(~ok & (votes > 0.5))
    tried = _last(models[0], texts, share, [every[i] for i in aside], 0.5, rng)
    rare = [every[i] for i in aside if abuse.scores(tried, every[i].split("\n")).max() >= 0.8]
    say("tried", len(aside), "rare wordings", len(rare))
    more, verdict = _agreed(scores[:, len(every) :], rest, rng, say, 3 * PSEUDO // 2)
    texts, share = [t for t, k in zip(every, ok) if k] + more, np.concatenate([(votes[ok] >= 0.5).astype("f4"), verdict])
    return _last(models[0], texts, share, rare, 1.0, rng)


def _last(w: dict, texts: list[str], share: np.ndarray, positive: list[str], trust: float, rng) -> dict[str, np.ndarray]:
    """The network taken further with texts and some more positive ones that count ``trust``."""
    trusts = np.concatenate([np.ones(len(texts)), np.full(len(positive), trust)])
    texts, share = texts + positive, np.concatenate([share, np.ones(len(positive), "f4")])
    order = rng.permutation(len(texts))
    return abuse.train([texts[i] for i in order], share[order], seed=30, rounds=12, rate=2e-3, start=w, trust=trusts[order])


def measure(folders: list[str], w: dict, say=print) -> None:
    """How the weights do on what was held out, against votes (which err)."""
    for f in folders:
        texts, share, n, rest = labelled(f, True)
        hit = all_scores(w, texts) >= abuse.THRESHOLD
        agreed, none, some = (n > 1) & (share == 1), share == 0, share > 0
        say(f"{f}: {len(texts)} documents with votes not fitted; found {int(hit.sum())}, of them {int((hit & some).sum())} with a positive vote;",
            f"of {int(agreed.sum())} with two positive votes {int((hit & agreed).sum())} found; of {int((none & (n > 1)).sum())} with two negative votes {int((hit & none & (n > 1)).sum())} found;",
            f"of {len(rest)} without votes {int((all_scores(w, rest) >= abuse.THRESHOLD).sum())} found")


if __name__ == "__main__":
    began = time.time()
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

    def say(*x) -> None:
        print(round(time.time() - began), *x, flush=True)

    folders = sys.argv[1:]
    if folders[:1] == ["measure"]:
        measure(folders[1:], abuse.load(), say)
    else:
        abuse.save(fit(folders, say))
        abuse.load.cache_clear()
        measure(folders, abuse.load(), say)
