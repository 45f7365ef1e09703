"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.decontaminate import words_of


#: Beginnings of words, in bytes, that are features beside the words: they carry over to words not seen.
PREFIXES = (4, 5, 6, 7)


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and marked by ^ their proper beginnings."""
    out = set(words)
    for n in PREFIXES:
        out.update(b"^" + w[:n] for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """One weight a feature, shared by all thresholds; the log-odds of a grade above k are score - thresholds[k]."""

    weights: dict[bytes, float]
    thresholds: list[float]
    limit: float  # least probability of a grade above 0 at which a text counts as toxic

    def above(self, words: set[bytes]) -> np.ndarray:
        """P(grade > k) for each k."""
        score = sum(sorted(self.weights[f] for f in features_of(words) & self.weights.keys()))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score, -60, 60)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def ordinal_loss(xt: np.ndarray, yt: np.ndarray, w: np.ndarray, theta: np.ndarray, ridge: float) -> float:
    """The penalised negative log-likelihood of P(y > k) = sigmoid(x w - theta_k)."""
    upper = np.concatenate([np.ones((len(yt), 1)), _sigmoid((xt @ w)[:, None] - theta), np.zeros((len(yt), 1))], axis=1)
    rows = np.arange(len(yt))
    return float(-np.log((upper[rows, yt] - upper[rows, yt + 1]).clip(1e-12)).sum() + ridge / 2 * (w @ w))


def fit_ordinal(xt: np.ndarray, yt: np.ndarray, top: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of the least ordinal_loss: Newton's steps on both take turns."""
    every = np.arange(len(yt))
    share = np.array([(yt > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    theta, w = np.log((1 - share) / share), np.zeros(xt.shape[1])

    def parts(w, theta):
        """By row: P(y >= its grade), P(y > its grade), and the likelihood."""
        upper = np.concatenate([np.ones((len(yt), 1)), _sigmoid((xt @ w)[:, None] - theta), np.zeros((len(yt), 1))], axis=1)
        lo, hi = upper[every, yt], upper[every, yt + 1]
        return lo, hi, (lo - hi).clip(1e-12)

    loss = lambda w, theta: ordinal_loss(xt, yt, w, theta, ridge)
    for _ in range(rounds):
        before = loss(w, theta)
        lo, hi, p = parts(w, theta)
        slope = xt.T @ (lo + hi - 1) + ridge * w
        bend = (xt * (lo * (1 - lo) + hi * (1 - hi))[:, None]).T @ xt + ridge * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step, theta) > before and size > 1e-4:
            size /= 2
        w = w - size * step
        for k in range(top):
            lo, hi, p = parts(w, theta)
            below, above = yt == k, yt == k + 1
            f, g = hi * (1 - hi) / p, lo * (1 - lo) / p
            slope_k = g[above].sum() - f[below].sum()
            bend_k = (f * f + f * (1 - 2 * hi))[below].sum() + (g * g - g * (1 - 2 * lo))[above].sum()
            now, size = loss(w, theta), 1.0
            while size > 1e-4:
                moved = theta.copy()
                moved[k] -= size * slope_k / max(bend_k, 1e-6)
                if (np.diff(moved) > 0).all() and loss(w, moved) <= now:
                    theta = moved
                    break
                size /= 2
        if before - loss(w, theta) < 1e-7 * abs(before):
            break
    return w, theta


def fit(rows: list[set[bytes]], grades: list[int], features: int = 400, least: int = 4, distinct: float = 5.0, ridge: float = 0.1, rounds: int = 40, levels: int = 3) -> Model:
    """The model of largest penalised likelihood: P(y > k) = sigmoid(x w - theta_k), with ``ridge`` x |w|^2 / 2.

    Features of at least ``least`` rows are fitted if their rows' mean grade is
    ``distinct`` standard errors from that of all, the ``features`` furthest at most, and
    one of those that stand in the same rows. Newton's steps on the weights and on the
    thresholds take turns (see fit_ordinal). Labels that are only 0 and 1 say nothing on
    how severe a text is; then severity is by definition ordinal in the number of marked
    words: rows of label 1 are parted evenly into ``levels`` grades by how many of their
    words are marked by a chosen feature of toxic rows. Graded labels are taken as they are. Every third row is left out to choose the limit of the best
    F1 (of equals the one nearest to 0.5).
    """
    y = np.array(grades)
    top = int(y.max(initial=0))
    held = np.arange(len(rows)) % 3 == 2
    if top == 0 or (y[~held] > 0).sum() == 0:
        return Model({}, [60.0], 0.5)
    count: dict[bytes, list[float]] = {}
    centre = y[~held] - y[~held].mean()
    for words, c in zip((r for r, h in zip(rows, held, strict=True) if not h), centre, strict=True):
        for w in features_of(words):
            s = count.setdefault(w, [0, 0.0])
            s[0] += 1
            s[1] += c
    spread = centre.std()
    ranked = sorted((-abs(s) / n**0.5, w) for w, (n, s) in count.items() if n >= least and abs(s) / n**0.5 >= distinct * spread)
    if top == 1 and levels > 1:
        marks = {w for _, w in ranked if count[w][1] > 0}
        marked = np.array([sum(1 for w in words if features_of({w}) & marks) for words in rows])
        cuts = np.quantile(marked[(y > 0) & ~held], np.arange(1, levels) / levels)
        y = np.where(y > 0, 1 + np.searchsorted(np.unique(cuts), marked, side="left"), 0)
        top = int(y[~held].max())
        y = y.clip(0, top)
    chosen = {w for _, w in ranked}
    known = [features_of(words) & chosen for words in rows]
    at: dict[bytes, int] = {}
    seen: set = set()
    for _, w in ranked:
        where = frozenset(i for i, f in enumerate(known) if w in f and not held[i])
        if where not in seen and len(at) < features:
            seen.add(where)
            at[w] = len(at)
    x = np.zeros((len(rows), len(at)))
    for i, f in enumerate(known):
        for w in f & at.keys():
            x[i, at[w]] = 1
    w, theta = fit_ordinal(x[~held], y[~held], top, ridge, rounds)
    p = _sigmoid(x @ w - theta[0])[held]
    best = (-1.0, 0.5)
    for limit in np.linspace(0.1, 0.9, 17):
        hit = p >= limit
        good = (hit & (y[held] > 0)).sum()
        f1 = 2 * good / max(1, hit.sum() + (y[held] > 0).sum())
        if f1 > best[0] + 1e-12 or f1 == best[0] and abs(limit - 0.5) < abs(best[1] - 0.5):
            best = (f1, float(limit))
    return Model({word: float(w[j]) for word, j in at.items()}, [float(z) for z in theta], best[1])


def train(docs: DataFrame, grades: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", most_rows: int = 6000, **options) -> Model:
    """A model from ``grades`` (doc_id, grade 0, 1, ...) and the documents' whole texts.

    At most ``most_rows`` labelled documents are used, those whose ids have the smallest
    hashes; the driver gets their distinct words. Rows without id or grade aren't used,
    and equal sets of words count once, with their first grade.
    """
    known = grades.where(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(grade).cast("int").alias("__grade"))
    chosen = known.withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(most_rows)

    @F.arrow_udf("array<binary>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(words_of(t.as_py()))) for t in texts], pa.list_(pa.binary()))

    few = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text")).join(chosen, "__id")
    got = few.select("__h", "__id", "__grade", distinct("__text").alias("words")).toArrow()
    order = sorted(zip(got["__h"].to_pylist(), got["__id"].to_pylist(), range(got.num_rows), strict=True))
    words, label = got["words"], got["__grade"].to_pylist()
    rows: dict[frozenset, int] = {}
    same: dict[bytes, bytes] = {}
    for _, _, i in order:
        rows.setdefault(frozenset(same.setdefault(w, w) for w in words[i].as_py()), label[i])
    return fit(list(rows), list(rows.values()), **options)


def rate(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct: severity (the expected grade), grade (the likeliest), p_toxic and toxic.

    Null and empty texts have no words: their severity is that of the thresholds alone.
    The model has at most some thousand words.
    """

    @F.arrow_udf("struct<severity: double, grade: int, p_toxic: double, toxic: boolean>")
    def udf(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            above = model.above(set(words_of(t.as_py())))
            p = np.concatenate([[1.0], above]) - np.concatenate([above, [0.0]])
            out.append({"severity": float(above.sum()), "grade": int(p.argmax()), "p_toxic": float(above[0]), "toxic": bool(above[0] >= model.limit)})
        return pa.array(out, pa.struct([("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())]))

    return docs.withColumn(name, udf(F.col(text).cast("binary")))
