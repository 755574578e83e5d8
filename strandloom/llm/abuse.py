"""Abusive, hateful or sexual content: a bidirectional gated recurrent network over words and their characters.

Every text is read whole.  It is folded (case, accents, look-alike letters, digits in place of letters, zero-width and
combining characters, letters pulled apart or repeated), cut into words (single characters for scripts without blanks, words
of LONG characters and more into overlapping pieces), and each word becomes the sum of an embedding of the word and of the
mean of its character trigrams.  Gated recurrent units read the words in both directions; attention pools the states of a
window of WINDOW words into one vector and a logistic unit scores it.  Every window is scored, so that a sentence's score
does not hang on where windows begin.  A document's score is that of its highest window.

All overlapping windows cost hardly more than one reading of the text: texts are read in blocks of BLOCK words, each from
CONTEXT words before it (behind it, backwards), and what a word adds to a window's attention and to its score are two numbers,
exp(e) and exp(e) * v.  A window's score is the quotient of their sums over its words, and sums over all windows of 32 words
take five shifted additions.

The network is trained in numpy (``train``); the weights beside this file were fitted by ``fit_abuse``.  Labels are of
documents: in each round the highest window of a document carries its label, raters' votes are averaged, and votes that
contradict the fitted model by far are left out of the last rounds.

Defined cases: null, empty and blank texts, and texts without a word, score 0; repeated texts score alike.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import spread

#: Words of a window; a power of two.
WINDOW = 32
#: Words of a block, and words before and behind it that its states have read.
BLOCK, CONTEXT = 112, 16
#: Neighbouring windows of which ``train`` takes one at most.
NEAR = 16
#: Characters from which a word is cut into pieces, characters of a piece and from one piece to the next.
LONG, PIECE, STEP = 24, 12, 6
WORDS, GRAMS, EMBED, HIDDEN = 1 << 14, 1 << 14, 24, 24
#: Documents with at least this score are found.
THRESHOLD = 0.5
WEIGHTS = os.path.join(os.path.dirname(__file__), "abuse_weights.npz")
#: Labelled documents that ``train`` takes at most.
MOST_LABELLED = 20_000

# Letters that look like Latin ones, and what stands for a letter inside a word.
ALIKE = dict(zip("авекмнорстухіјѕԁһɡαβεικνορτυχ", "abekmhopctyxijsdhgabeiknoptux"))
LEET = dict(zip("013457@$!|", "oieastasil"))

_SEPARATOR, _STAR, _PAD = 0, 1, 0
_DIGIT0 = 2  # digits are 2..11, letters come after
_LETTER0 = 12


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """code: per code point 0 separator, 1 star, 2.. digits, 12.. letters; kind: 1 letter, 2 digit, 4 special (inside words
    only), 8 a word of its own, 16 to be dropped."""
    size = 0x1D800
    code, kind = np.zeros(size, "u4"), np.zeros(size, "u1")
    for cp in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Mn", "Cf", "Me"):
            kind[cp] = 16
            continue
        if 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7AF:
            code[cp], kind[cp] = _LETTER0 + cp, 8
            continue
        flat = unicodedata.normalize("NFKD", ch)[:1].lower()
        flat = unicodedata.normalize("NFKD", flat)[:1]
        flat = ALIKE.get(flat, flat)
        if flat.isdigit() and flat.isascii():
            code[cp], kind[cp] = _DIGIT0 + int(flat), 2
        elif flat.isalpha():
            code[cp], kind[cp] = _LETTER0 + ord(flat), 1
        elif ch in "@$!|":
            code[cp], kind[cp] = _LETTER0 + ord(LEET[ch]), 4
        elif ch in "*#":
            code[cp], kind[cp] = _STAR, 4
    return code, kind


_LEET_OF = np.arange(_LETTER0, dtype="u4")
for _d, _l in LEET.items():
    if _d.isdigit():
        _LEET_OF[_DIGIT0 + int(_d)] = _LETTER0 + ord(_l)
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, "u8"))
_NUMBER, _BLOB = np.uint64(1), np.uint64(2)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, doc, ids, grams): for each word of all texts its index among the distinct words and its text; for each
    distinct word its bucket, and [distinct, 2] where its trigrams lie in the flat array returned as grams[0]."""
    code_of, kind_of = _table()
    parts = [(t or "").encode("utf-32-le", "replace") for t in texts]
    lengths = np.array([len(p) // 4 + 1 for p in parts])
    cp = np.frombuffer(b"\n\0\0\0".join(parts) + b"\n\0\0\0", "<u4")
    doc = np.repeat(np.arange(len(texts), dtype="i4"), lengths)
    cp = np.where(cp < len(code_of), cp, 0x20)
    kind = kind_of[cp]
    if (kind == 16).any():
        keep = kind != 16
        cp, doc, kind = cp[keep], doc[keep], kind[keep]
    code = code_of[cp]
    alnum = (kind == 1) | (kind == 2)
    pad = np.zeros(1, bool)

    def before(x):
        return np.concatenate([pad, x[:-1]])

    def behind(x):
        return np.concatenate([x[1:], pad])

    # encoded data: long runs without a blank, of capitals, small letters and other ASCII, are one word
    solid = (cp > 0x20) & (cp < 0x7F)
    open_ = np.flatnonzero(solid & ~before(solid))
    close = np.flatnonzero(solid & ~behind(solid)) + 1
    blob = np.zeros(len(cp), bool)
    for s, e in zip(*[x[close - open_ >= 24] for x in (open_, close)]):
        part = cp[s:e]
        upper, lower = ((part >= 0x41) & (part <= 0x5A)).sum(), ((part >= 0x61) & (part <= 0x7A)).sum()
        blob[s:e] = upper >= 5 and lower >= 5 and e - s - upper - lower >= 2
    # letters pulled apart: drop a separator between two letters that stand alone
    alone = (kind == 1) & ~before(alnum) & ~behind(alnum)
    apart = before(alone) & behind(alone) & ~alnum & (cp != 0x0A)
    wordy = alnum | (kind == 4)
    inside = alnum | ((kind == 4) & before(wordy) & behind(wordy))
    inside |= (cp == 0x27) & before(kind == 1) & behind(kind == 1)
    inside |= blob
    own = (kind == 8) & ~blob
    keep = ~apart & ~(inside & (cp == 0x27) & ~blob) | blob  # an apostrophe inside a word goes without a gap
    code, doc, kind, inside, own, cp, blob = (x[keep] for x in (code, doc, kind, inside, own, cp, blob))
    used = inside | own
    start = (inside & ~before(inside)) | own
    hexa = ((cp >= 0x30) & (cp <= 0x39)) | ((cp >= 0x61) & (cp <= 0x66))
    code, doc, kind, start, blob, hexa = (x[used] for x in (code, doc, kind, start, blob, hexa))
    if not len(code):
        none = np.zeros(0, "i8")
        return none, none.astype("i4"), none, np.zeros((0, 3), "i8")
    first = np.flatnonzero(start)
    whole = np.diff(np.append(first, len(code)))
    hashes = (np.add.reduceat(hexa, first) == whole) & (whole >= 6) & (np.add.reduceat(kind == 2, first) > 0)
    blobs = blob[first]
    # a repeated letter counts once
    single = start | (code != np.concatenate([[0], code[:-1]]))
    code, doc, kind, start = code[single], doc[single], kind[single], start[single]
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(code)))
    digits = np.add.reduceat(kind == 2, first)
    # digits in words that hold letters stand for letters
    lettered = np.repeat(digits < size, size)
    plain = np.where(lettered & (kind == 2), _LEET_OF[np.minimum(code, _LETTER0 - 1)], code).astype("u8")
    numbers = digits == size
    encoded = ((size >= 16) & (digits >= 3) & ~numbers) | blobs | hashes
    # long words become overlapping pieces, the last one at the word's end
    n_pieces = np.where((size >= LONG) & ~numbers & ~encoded, 1 + -(-(size - PIECE) // STEP), 1)
    of = np.repeat(np.arange(len(first)), n_pieces)
    k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n_pieces)[:-1]]), n_pieces)
    cut = n_pieces[of] > 1
    shift = np.where(cut, np.minimum(k * STEP, size[of] - PIECE), 0)
    first, size, numbers, encoded = first[of] + shift, np.where(cut, PIECE, size[of]), numbers[of], encoded[of]
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    h = _mix(np.add.reduceat((plain[np.repeat(first, size) + at] + np.uint64(7)) * _POW[at % 4096], begin[:-1]))
    h[numbers] = _NUMBER
    h[encoded] = _BLOB
    # runs of numbers or of blobs are one word
    same = (h <= _BLOB) & np.concatenate([pad, h[1:] == h[:-1]])
    doc_of = doc[first]
    first, size, h, doc_of = first[~same], size[~same], h[~same], doc_of[~same]
    distinct, where, word = np.unique(h, return_index=True, return_inverse=True)
    ids = (distinct % np.uint64(WORDS)).astype("i8")
    # trigrams of the distinct words, one a character, with a mark at both ends
    f, n = first[where], size[where]
    fixed = distinct <= _BLOB
    n = np.where(fixed, 1, n)
    offset = np.concatenate([[0], np.cumsum(n)])
    pos = np.repeat(f - offset[:-1], n) + np.arange(offset[-1])
    mid = plain[pos]
    edge_l, edge_r = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    edge_l[offset[:-1]], edge_r[offset[1:] - 1] = True, True
    left = np.where(edge_l, 3, plain[np.maximum(pos - 1, 0)])
    right = np.where(edge_r, 5, plain[np.minimum(pos + 1, len(plain) - 1)])
    g = _mix(left * np.uint64(0x100000001B3) + mid * np.uint64(0x9E3779B1) + right * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(GRAMS)
    g[np.repeat(fixed, n)] = 0
    return word.astype("i8"), doc_of, ids, (g.astype("i8"), offset)


def places(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, count, at) of each text: its first word, its number of words, and where its windows lie in ``window_logits``."""
    count = np.bincount(doc, minlength=n_docs)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    room = -(-np.maximum(count, WINDOW) // NEAR) * NEAR
    return begin, count, np.concatenate([[0], np.cumsum(room)])


def _index(word: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, pad: int) -> np.ndarray:
    """[rows, width]: the words from each start on; those before ``low`` and from ``high`` on are padding."""
    index = start[:, None] + np.arange(width)
    return np.where((index >= low[:, None]) & (index < high[:, None]), word[np.clip(index, 0, len(word) - 1)], pad)


def windows_of(word: np.ndarray, begin: np.ndarray, count: np.ndarray, start: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(index [windows, CONTEXT + WINDOW + CONTEXT], length): windows from the ``start`` given, between CONTEXT words of their
    text (which begins at ``begin`` and has ``count`` words) on either side."""
    index = _index(word, start - CONTEXT, begin, begin + count, 2 * CONTEXT + WINDOW, pad)
    return index, np.minimum(WINDOW, begin + count - start)


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return rng.normal(0, scale, shape).astype("f4")

    return {
        "words": normal(WORDS, EMBED, scale=0.1),
        "grams": normal(GRAMS, EMBED, scale=0.1),
        "input": normal(EMBED, 6 * HIDDEN, scale=EMBED**-0.5),
        "bias": np.zeros(6 * HIDDEN, "f4"),
        "fore": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "back": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "attend": normal(2 * HIDDEN, scale=0.3),
        "out": normal(2 * HIDDEN, scale=0.3),
        "out_bias": np.full(1, -2, "f4"),
    }


def embed(w: dict, ids: np.ndarray, grams: tuple) -> np.ndarray:
    """[distinct words, EMBED]"""
    g, offset = grams
    if not len(ids):
        return np.zeros((0, EMBED), "f4")
    return w["words"][ids] + np.add.reduceat(w["grams"][g], offset[:-1]) / np.diff(offset)[:, None].astype("f4")


def _project(w: dict, x: np.ndarray) -> np.ndarray:
    """Gate inputs of the distinct words and, last, of the padding, which leaves states as they are."""
    rest = np.zeros((1, 6 * HIDDEN), "f4")
    rest[0, :HIDDEN] = rest[0, 3 * HIDDEN : 4 * HIDDEN] = 40
    return np.concatenate([x @ w["input"] + w["bias"], rest])


def _run(p: np.ndarray, index: np.ndarray, u: np.ndarray, backward: bool, keep: list | None = None):
    """The states of one direction as (place, [rows, HIDDEN]), step by step; ``keep`` takes what the gradient needs."""
    hid = HIDDEN
    part = np.ascontiguousarray(p[:, 3 * hid :] if backward else p[:, : 3 * hid])
    h = np.zeros((len(index), hid), part.dtype)
    for t in range(index.shape[1] - 1, -1, -1) if backward else range(index.shape[1]):
        x = part[index[:, t]]
        a = h @ u
        zr = np.tanh(0.5 * (x[:, : 2 * hid] + a[:, : 2 * hid])) * 0.5 + 0.5
        z, r = zr[:, :hid], zr[:, hid:]
        m = a[:, 2 * hid :]
        c = np.tanh(x[:, 2 * hid :] + r * m)
        if keep is not None:
            keep.append((t, h, z, r, m, c))
        h = c + z * (h - c)
        yield t, h


def forward(w: dict, p: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of windows with their context, as ``windows_of`` gives them."""
    hid, n = HIDDEN, len(index)
    kf, kb = ([], []) if keep else (None, None)
    f, b = np.empty((WINDOW, n, hid), p.dtype), np.empty((WINDOW, n, hid), p.dtype)
    for t, h in _run(p, index[:, : CONTEXT + WINDOW], w["fore"], False, kf):
        if t >= CONTEXT:
            f[t - CONTEXT] = h
    for t, h in _run(p, index[:, CONTEXT:], w["back"], True, kb):
        if t < WINDOW:
            b[t] = h
    e = f @ w["attend"][:hid] + b @ w["attend"][hid:]  # [time, windows]
    e = np.where(np.arange(WINDOW)[:, None] < length[None, :], e, -1e9)
    e = np.exp(e - e.max(0))
    a = e / e.sum(0)
    pooled = np.concatenate([np.einsum("tn,tnh->nh", a, f), np.einsum("tn,tnh->nh", a, b)], 1)
    logit = pooled @ w["out"] + w["out_bias"][0]
    return (logit, (f, b, kf, kb, a, pooled)) if keep else logit


def _word_terms(w: dict, p: np.ndarray, word: np.ndarray, begin: np.ndarray, count: np.ndarray, rows: int = 2000) -> np.ndarray:
    """[words, 2]: what each word adds to the attention (e) and to the score (v) of the windows that hold it."""
    hid, pad = HIDDEN, len(p) - 1
    n_blocks = -(-count // BLOCK)
    of = np.repeat(np.arange(len(count)), n_blocks)
    k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n_blocks)[:-1]]), n_blocks)
    low, high = begin[of], begin[of] + count[of]
    start = low + k * BLOCK
    size = np.minimum(BLOCK, high - start)
    out = np.empty((len(word), 2), "f4")
    order = np.argsort(size, kind="stable")  # blocks of like size together: the step count is that of the largest
    fore, back = (np.stack([w["attend"][s], w["out"][s]], 1) for s in (slice(0, hid), slice(hid, None)))
    for s in range(0, len(order), rows):
        b = order[s : s + rows]
        most = int(size[b[-1]])
        got = np.zeros((most, len(b), 2), "f4")
        lead = CONTEXT if k[b].any() else 0
        for t, h in _run(p, _index(word, start[b] - lead, low[b], start[b] + size[b], lead + most, pad), w["fore"], False):
            if t >= lead:
                got[t - lead] = h @ fore
        trail = CONTEXT if (start[b] + size[b] < high[b]).any() else 0
        for t, h in _run(p, _index(word, start[b], low[b], high[b], most + trail, pad), w["back"], True):
            if t < most:
                got[t] += h @ back
        t, row = np.nonzero(np.arange(most)[:, None] < size[b][None, :])
        out[start[b][row] + t] = got[t, row]
    return out


def window_logits(w: dict, p: np.ndarray, word: np.ndarray, begin: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logit of every window: the one from word k of text d is at ``at[d] + k``; places without a window hold -inf.  A text
    of fewer words than WINDOW is one window."""
    terms = _word_terms(w, p, word, begin, count)
    k = np.arange(len(word)) - np.repeat(begin, count)
    place = np.repeat(at[:-1], count) + k
    # states lie within -1..1, so e is no larger than the sum of the weights and needs no shift in double precision
    sums = np.zeros((2, at[-1] + WINDOW - 1))
    sums[0, place] = np.exp(terms[:, 0].astype("f8"))
    sums[1, place] = sums[0, place] * terms[:, 1]
    step = 1
    while step < WINDOW:
        sums = sums[:, :-step] + sums[:, step:]
        step *= 2
    ends = k <= np.maximum(np.repeat(count, count) - WINDOW, 0)
    place = place[ends]
    out = np.full(at[-1], -np.inf)
    out[place] = sums[1, place] / sums[0, place] + w["out_bias"][0]
    return out


def scores(w: dict, texts: list[str | None]) -> np.ndarray:
    """The highest window's probability for each text."""
    word, doc, ids, grams = words_of(texts)
    if not len(word):
        return np.zeros(len(texts), "f8")
    begin, count, at = places(doc, len(texts))
    best = np.maximum.reduceat(window_logits(w, _project(w, embed(w, ids, grams)), word, begin, count, at), at[:-1])
    return 1 / (1 + np.exp(-best))


# ---- training


def _backward(w: dict, cache, index: np.ndarray, length: np.ndarray, dlogit: np.ndarray, n_words: int):
    """Gradients of all weights but the embeddings, and of the gate inputs of the distinct words."""
    f, b, kf, kb, a, pooled = cache
    hid = HIDDEN
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("words", "grams")}
    g["out"] = pooled.T @ dlogit
    g["out_bias"] = np.array([dlogit.sum()], "f4")
    dpool = dlogit[:, None] * w["out"]
    da = np.einsum("tnh,nh->tn", f, dpool[:, :hid]) + np.einsum("tnh,nh->tn", b, dpool[:, hid:])
    de = a * (da - (a * da).sum(0))
    g["attend"] = np.concatenate([np.einsum("tn,tnh->h", de, f), np.einsum("tn,tnh->h", de, b)])
    df = a[:, :, None] * dpool[None, :, :hid] + de[:, :, None] * w["attend"][:hid]
    db = a[:, :, None] * dpool[None, :, hid:] + de[:, :, None] * w["attend"][hid:]
    dp = np.zeros((n_words + 1, 6 * hid), "f4")
    # the window is at CONTEXT of what is read forwards and at 0 of what is read backwards
    for name, kept, dstate, at, shift in (("fore", kf, df, 0, CONTEXT), ("back", kb, db, 3 * hid, 0)):
        dh = np.zeros((len(index), hid), "f4")
        u = w[name]
        for t, h, z, r, m, c in reversed(kept):
            if 0 <= t - shift < WINDOW:
                dh = dh + dstate[t - shift]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], 1)
            da_ = np.concatenate([dz, dr, dc * r], 1)
            g[name] += h.T @ da_
            np.add.at(dp[:, at : at + 3 * hid], index[:, t + CONTEXT - shift], dx)
            dh = dh * z + da_ @ u.T
    return g, dp[:-1]


def train(texts: list[str], share: np.ndarray, seed: int = 1, rounds: int = 24, rate: float = 4e-3, log=None, start=None, trust: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights fitted to texts with the share of raters that found them abusive (0..1).

    At most MOST_LABELLED texts are used; every text is used whole.  start: weights to go on from.  trust: how much
    each text counts (1 by default).
    """
    texts, share = list(texts[:MOST_LABELLED]), np.asarray(share[:MOST_LABELLED], "f4")
    rng = np.random.default_rng(seed)
    w = {k: v.copy() for k, v in start.items()} if start else new_weights(seed)
    word, doc, ids, grams = words_of(texts)
    begin, count, place = places(doc, len(texts))
    g_flat, offset = grams
    n_grams = np.diff(offset)
    gram_word = np.repeat(np.arange(len(ids)), n_grams)
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    step, trust = 0, np.ones(len(texts), "f4") if trust is None else np.asarray(trust[:MOST_LABELLED], "f4")
    weight = trust
    for r in range(rounds):
        p = _project(w, embed(w, ids, grams))
        every = window_logits(w, p, word, begin, count, place)
        # the highest of neighbouring windows stands for them
        near = every.reshape(-1, NEAR)
        start = np.arange(len(near)) * NEAR + near.argmax(1)
        start = start[np.isfinite(every[start])]
        logit, of = every[start], np.searchsorted(place, start, side="right") - 1
        start = start - place[of] + begin[of]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, of, logit)
        if r >= rounds // 2:  # votes far from the model are taken for raters' errors
            prob = 1 / (1 + np.exp(-top))
            weight = np.where(np.abs(prob - share) > 0.8, 0.0, trust).astype("f4")
        noisy = logit + rng.normal(0, 1.0 if r < 3 else 0.1, len(logit))
        order = np.lexsort((-noisy, of))
        rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))[:-1]])[of[order]]
        chosen = order[(rank < 1) | ((rank < 2) & (share[of[order]] == 0)) | ((share[of[order]] == 0) & (rng.random(len(order)) < 0.08))]
        rng.shuffle(chosen)
        lr, loss_sum = rate * (1 - r / rounds) + 1e-4, 0.0
        for s in range(0, len(chosen), 512):
            mine = chosen[s : s + 512]
            index, length = windows_of(word, begin[of[mine]], count[of[mine]], start[mine], len(ids))
            used, local = np.unique(index, return_inverse=True)
            used = used[used < len(ids)]
            local = local.reshape(index.shape)
            rows = np.flatnonzero(np.isin(gram_word, used)) if len(used) > len(ids) // 2 else np.concatenate([np.arange(offset[u], offset[u + 1]) for u in used])
            off = np.concatenate([[0], np.cumsum(n_grams[used])])
            small = (g_flat[rows], off)
            x = embed(w, ids[used], small)
            keep_x = (rng.random((len(used), 1)) > 0.15).astype("f4")  # words fall out at random
            pp = _project(w, x * keep_x)
            lg, cache = forward(w, pp, local, length, keep=True)
            target = share[of[mine]] * 0.96 + 0.02
            prob = 1 / (1 + np.exp(-lg))
            k = weight[of[mine]] * np.where(share[of[mine]] > 0, 3.0, 1.0).astype("f4")
            loss_sum += float(-(k * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum())
            g, dp = _backward(w, cache, local, length, (k * (prob - target) / len(mine)).astype("f4"), len(used))
            g["input"], g["bias"] = (x * keep_x).T @ dp, dp.sum(0)
            dx = (dp @ w["input"].T) * keep_x
            g["words"] = np.zeros_like(w["words"])
            np.add.at(g["words"], ids[used], dx)
            g["grams"] = np.zeros_like(w["grams"])
            np.add.at(g["grams"], small[0], np.repeat(dx / n_grams[used][:, None].astype("f4"), n_grams[used], axis=0))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9)) + 1e-5 * w[name]
                m1[name] = 0.9 * m1[name] + 0.1 * v
                m2[name] = 0.99 * m2[name] + 0.01 * v * v
                w[name] -= (lr * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)).astype("f4")
        if log:
            log(r, loss_sum / len(chosen), top)
    return w


def save(w: dict, path: str = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype("f2") for k, v in w.items()})


@lru_cache(2)
def load(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    if os.path.exists(path):
        with np.load(path) as z:
            return {k: z[k].astype("f4") for k in z.files}
    import io
    import pkgutil  # the package may be a zip on the executors

    with np.load(io.BytesIO(pkgutil.get_data("strandloom.llm", os.path.basename(path)))) as z:
        return {k: z[k].astype("f4") for k in z.files}


def score(documents: DataFrame, keep: list[str], text_column: str = "text", weights: str = WEIGHTS) -> DataFrame:
    """The ``keep`` columns and the score of every row; map-only."""
    kept = spread(documents.select(*keep, documents[text_column].alias("_text")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = load(weights)
        for batch in batches:
            k = batch.num_columns - 1
            texts = batch.column(k).to_pylist()
            at = 0
            while at < len(texts):  # a few million characters at a time
                begin, size = at, 0
                while at < len(texts) and (size < 2_000_000 or at == begin):
                    size += len(texts[at] or "") + 1
                    at += 1
                got = pa.array(scores(w, texts[begin:at]), pa.float64())
                yield pa.RecordBatch.from_arrays([*[c.slice(begin, at - begin) for c in batch.columns[:k]], got], names=[*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, score double")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, found, rate); documents without a source are the source ``""``."""
    hit = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scored.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("found"), (F.sum(hit) / F.count(F.lit(1))).alias("rate"))
