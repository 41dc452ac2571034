"""Abusive, hateful or sexual content (problem 10).

A support vector machine with a gap-weighted subsequence string kernel. Texts are reduced to their letters (in the
consistent form, digits and signs that stand for letters undone), so inserted signs and spaces vanish and inserted
letters are gaps. The kernel compares stretches of ``WINDOW`` letters by their common subsequences of two to four
letters, each gap weighted by ``DECAY``. Nyström landmarks, taken among the stretches that matter in training, give
explicit features; as the machine is linear in them, landmarks and coefficients fold into one weight per hashed
subsequence, and scoring a text is a running sum over its letters whatever the number of landmarks.

Reviewers judge whole documents, and some judgements are wrong. The stretch that makes a document abusive isn't
marked: it is found by multiple-instance training, which starts from log odds of subsequences and in each round takes
the best-scoring stretch of every document, abusive ones as positive, the others as negative examples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkstone.llm.canon import DOT, canonical
from inkstone.session import hash_limit

WINDOW = 14
BITS = 18
NONE = 1 << BITS
DECAY = 0.6
#: Offsets of the letters of a subsequence, with its number of gaps.
SUBSEQUENCES = [((0, 1), 0), ((0, 2), 1), ((0, 3), 2), ((0, 1, 2), 0), ((0, 1, 3), 1), ((0, 2, 3), 1), ((0, 1, 4), 2), ((0, 2, 4), 2), ((0, 3, 4), 2), ((0, 1, 2, 3), 0), ((0, 1, 2, 4), 1), ((0, 1, 3, 4), 1), ((0, 2, 3, 4), 1)]
_BY_LENGTH = {2: 0.5, 3: 1.0, 4: 0.7}
WEIGHTS = np.array([DECAY**gaps * _BY_LENGTH[len(at)] for at, gaps in SUBSEQUENCES], "f4")

# Digits and signs that stand for Latin letters.
_STANDS_FOR = str.maketrans("01!$@357", "oiisaest")
_TOKEN = re.compile(r"\S*[a-z]\S*")
_NOT_LETTER = re.compile(rf"[\W\d_{DOT}]+")


def letters(text: str | None) -> str:
    """The letters of a text, in lower case and one form, without anything between them."""
    plain = (canonical(text) or "").lower()
    return _NOT_LETTER.sub("", _TOKEN.sub(lambda m: m[0].translate(_STANDS_FOR), plain))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each kind of subsequence the hashed feature that starts at each position; ``NONE`` where one ends early."""
    n = len(codes)
    c = np.concatenate([codes, np.zeros(5, np.uint64)])
    for at, _ in SUBSEQUENCES:
        h = np.full(n, np.uint64(len(at) * 0x9E37 + 1))
        there = np.ones(n, bool)
        for o in at:
            h = (h ^ c[o : o + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            there &= c[o : o + n] > 0
        yield np.where(there, ((h >> np.uint64(20)) & np.uint64(NONE - 1)).astype("i4"), NONE)


def _features(streams: list[np.ndarray], letters_per_batch: int = 200_000) -> list[np.ndarray]:
    """The features of each text, a row a letter; texts are hashed many at a time, with a gap between any two."""
    out: list[np.ndarray] = []
    pad, batch, held = np.zeros(WINDOW, np.uint64), [], 0
    for i, stream in enumerate(streams):
        batch.append(stream)
        held += len(stream)
        if held >= letters_per_batch or i == len(streams) - 1:
            whole = np.stack(list(_hashes(np.concatenate([x for s in batch for x in (s, pad)]))), axis=1)
            at = 0
            for s in batch:
                out.append(whole[at : at + len(s)])
                at += len(s) + WINDOW
            batch, held = [], 0
    return out


def _best(v: np.ndarray, features: np.ndarray) -> tuple[int, float]:
    """Start and sum of the best stretch."""
    s = v[features] @ WEIGHTS
    if len(s) <= WINDOW:
        return 0, float(s.sum())
    run = np.concatenate([[0.0], np.cumsum(s, dtype="f8")])
    sums = run[WINDOW:] - run[:-WINDOW]
    at = int(sums.argmax())
    return at, float(sums[at])


def _vector(features: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Distinct features of a stretch with their weights at unit length, and the length."""
    ids = features.ravel()
    kept = ids < NONE
    unique, at = np.unique(ids[kept], return_inverse=True)
    w = np.bincount(at, np.broadcast_to(WEIGHTS, features.shape).ravel()[kept], len(unique))
    length = float(np.sqrt((w * w).sum())) or 1.0
    return unique, (w / length).astype("f4"), length


@dataclass
class AbuseModel:
    """A weight per hashed subsequence and an offset; scores over ``threshold`` are abusive."""

    weights: np.ndarray
    offset: float
    threshold: float = -0.2

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of the most abusive stretch of each text; texts without letters score -1."""
        streams = [_codes(letters(t)) for t in texts]
        out = np.full(len(texts), -1.0)
        if not streams:
            return out
        pad = np.zeros(WINDOW, np.uint64)
        joined = np.concatenate([x for s in streams for x in (s, pad)])
        sums = np.zeros(len(joined), "f4")
        for kind, w in zip(_hashes(joined), WEIGHTS, strict=True):
            sums += w * self.weights[kind]
        run = np.concatenate([[0.0], np.cumsum(sums, dtype="f8"), np.zeros(WINDOW)])
        run[-WINDOW:] = run[len(sums)]
        window = run[WINDOW:][: len(sums)] - run[: len(sums)]
        starts = np.cumsum([0] + [len(s) + WINDOW for s in streams])[:-1]
        for i, (s, a) in enumerate(zip(streams, starts, strict=True)):
            if len(s):
                out[i] = window[a : a + max(1, len(s) - WINDOW + 1)].max() + self.offset
        return out


def _log_odds(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    held = np.zeros((2, NONE + 1))
    for f, label in zip(features, y, strict=True):
        held[int(label), np.unique(f)] += 1
    n = np.bincount(y.astype(int), minlength=2)
    v = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    v = np.where(held.sum(axis=0) >= 2, np.maximum(v, -1.0), 0.0)
    v[NONE] = 0
    return v.astype("f4")


def _nystrom(landmarks: list[tuple[np.ndarray, np.ndarray, float]]):
    """Kernel values against the landmarks, and the folding of coefficients into feature weights."""
    used = np.unique(np.concatenate([u for u, _, _ in landmarks]))
    matrix = np.zeros((len(used) + 1, len(landmarks)), "f4")
    for j, (u, w, _) in enumerate(landmarks):
        matrix[np.searchsorted(used, u), j] = w

    def kernel(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
        out = np.zeros((len(rows), len(landmarks)), "f4")
        for i, (u, w, _) in enumerate(rows):
            at = np.minimum(np.searchsorted(used, u), len(used) - 1)
            hit = used[at] == u
            out[i] = w[hit] @ matrix[at[hit]]
        return out

    def fold(alpha: np.ndarray) -> np.ndarray:
        v = np.zeros(NONE + 1, "f4")
        v[used] = matrix[:-1] @ alpha.astype("f4")
        return v

    return kernel, fold


def _chosen(rng: np.random.Generator, v: np.ndarray, stretch: list, positive: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Positive stretches for landmarks. Half are dealt in turn from groups that share their weightiest subsequence, so
    rare expressions and languages are among them; half are drawn from the better-scoring 85 % of the rest."""
    groups: dict[int, list[int]] = {}
    for i in sorted(positive.tolist(), key=lambda i: -scores[i]):
        u, w, _ = stretch[i]
        if len(u):
            groups.setdefault(int(u[np.argmax(v[u] * w)]), []).append(i)
    deal = sorted((turn, -scores[i], i) for members in groups.values() for turn, i in enumerate(members))
    dealt = np.array([i for _, _, i in deal[: count // 2]], "i8")
    rest = np.setdiff1d(positive, dealt)
    likely = rest[np.argsort(-scores[rest], kind="stable")][: int(len(rest) * 0.85)]
    return np.concatenate([dealt, rng.choice(likely, min(count - len(dealt), len(likely)), replace=False)]).astype("i8")


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the examples inside the margin; offset last."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(xb.shape[1]) / c
    ridge[-1, -1] *= 1e-3
    w = np.zeros(xb.shape[1])
    for _ in range(30):
        inside = y * (xb @ w) < 1
        a, k = xb[inside], cost[inside]
        new = np.linalg.solve((a * k[:, None]).T @ a + ridge, a.T @ (k * y[inside]))
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def train(texts: list[str], labels: list[int], landmarks: int = 400, rounds: int = 3, c: float = 2.0, seed: int = 1) -> AbuseModel:
    """Fits the machine; without examples of both kinds it finds nothing abusive. Deterministic for the same rows."""
    docs = [_codes(letters(t)) for t in texts]
    kept = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in kept], np.array([labels[i] for i in kept], "i8")
    if not docs or y.min(initial=1) == y.max(initial=0) or len(set(y.tolist())) < 2:
        return AbuseModel(np.zeros(NONE + 1, "f4"), -1.0)
    rng = np.random.default_rng(seed)
    features = _features(docs)
    v, offset = _log_odds(features, y), 0.0
    for _ in range(rounds):
        stretch, scores, chance = [], [], []
        for f, label in zip(features, y, strict=True):
            at, s = _best(v, f)
            stretch.append(_vector(f[at : at + WINDOW]))
            scores.append(s)
            if not label:
                for at in rng.integers(0, max(1, len(f) - WINDOW), 2):
                    chance.append(_vector(f[at : at + WINDOW]))
        positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        chosen = _chosen(rng, v, stretch, positive, np.array(scores), int(landmarks * 0.7))
        others = rng.choice(negative, min(landmarks - len(chosen), len(negative)), replace=False)
        kernel, fold = _nystrom([stretch[i] for i in (*chosen, *others)])
        value, basis = np.linalg.eigh(kernel([stretch[i] for i in (*chosen, *others)]).astype("f8"))
        basis = basis[:, value > 1e-3] / np.sqrt(value[value > 1e-3])
        x = kernel(stretch + chance).astype("f8") @ basis
        sign = np.concatenate([np.where(y == 1, 1.0, -1.0), np.full(len(chance), -1.0)])
        w = _svm(x, sign, np.concatenate([np.ones(len(y)), np.full(len(chance), 0.3)]), c)
        usual = float(np.mean([stretch[i][2] for i in positive]))
        v, offset = fold(basis @ w[:-1]) / usual, float(w[-1])
    return AbuseModel(v, offset)


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labelled: int = 6_000) -> AbuseModel:
    """Fits on at most ``max_labelled`` reviewed documents, taken in the order of a hash of the key.

    A document's reviews count once each; where they are at odds, in equal number, it is left out, as are null
    keys, texts and labels.
    """
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct().groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y <> 0.5")
    share = min(1.0, 2 * max_labelled / max(1, votes.count()))
    votes = votes.withColumn("h", F.xxhash64(F.lit(10), "k")).where(F.col("h") <= hash_limit(share)).orderBy("h", "k").limit(max_labelled)
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(votes, "k").select("h", "k", "t", "y").collect()
    rows.sort(key=lambda r: (r["h"], r["k"], r["t"]))
    return train([r["t"] for r in rows], [int(r["y"] > 0.5) for r in rows])


def score(df: DataFrame, text: str, model: AbuseModel) -> DataFrame:
    """Adds ``score`` and ``flagged``, in place of columns that have these names; null texts and texts without letters
    score -1 and aren't flagged. Every row keeps its place, repeated ones too."""

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        out = [model.score(texts.iloc[a : a + 500].tolist()) for a in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return df.withColumn("score", scored(F.col(text))).withColumn("flagged", F.col("score") > model.threshold)
