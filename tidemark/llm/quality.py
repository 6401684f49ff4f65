"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1, unlabelled web text is a sample of the
documents. Rows labelled 0 are not used as negatives. The class prior of the unlabelled text is
estimated first, then the non-negative unbiased risk is minimised,

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

with the logistic loss over features of the text's form and their squares and products.

Features are computed once for every document and written as a narrow table. Their means and
spreads and the class prior come from all documents that are not held out (crc32 of the id mod 5
is 0), by aggregates. The classifier itself is fitted on bounded samples, lowest hash of the id
first: at most ``MAX_POSITIVE`` labelled rows, and as the unlabelled side of the risk at most
``MAX_UNLABELLED`` rows; both are parameters. Nulls are empty texts, which get a score too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out, map_slices, table
from tidemark.llm.learning import Scale, logistic, sample_ids, sigmoid

MAX_POSITIVE, MAX_UNLABELLED = 20_000, 20_000
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other, then lower, upper, digit, blank, stop, bracket or bar, sign
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4), (b".,;:!?'\"-", 5), (b"|<>{}[]()", 6), (b"#$%&*+/=@\\^_`~", 7)):
    _CLASS[list(_chars)] = _k
FEATURES = 20


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of letters, words and lines; all of the text counts."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
    n, size = len(words), len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(x[-1:] in b".!?\"" for x in (y.rstrip() for y in lines))
    short = sum(len(w) == 1 for w in words)
    top = sorted(counts.values(), reverse=True)
    out[:8] = kinds / size
    out[8:] = (
        len(counts) / n,
        top[0] / n,
        sum(top[:5]) / n,
        repeats / n,
        min(1.0, np.log(n) / 12),
        len(set(lines)) / len(lines),
        ends / len(lines),
        min(1.0, n / len(lines) / 100),
        min(1.0, sum(map(len, words)) / n / 20),
        short / n,
        raw.count(b"!") / n,
        len(counts) / n ** 0.75,
    )
    return out


def expanded(x: np.ndarray) -> np.ndarray:
    """With squares and products of all pairs of standard features."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, np.clip(x[:, i] * x[:, j], -8, 8)])


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Scores that keep at least a tenth of the positives above them."""
    return np.quantile(positive, np.linspace(0.0, 0.9, 46)) if len(positive) else np.zeros(0)


def above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores are at each cut or above."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts, side="left")


def estimate_prior(positive: np.ndarray, unlabelled_above: np.ndarray, n: int) -> float:
    """The share of positives among ``n`` unlabelled rows, from scores that part the two: above any
    cut the unlabelled hold at least the prior's share of what the positives hold; the least
    such quotient, over cuts that keep enough positives, is the estimate."""
    if not len(positive) or not n:
        return 0.5
    kept = above(positive, prior_cuts(positive)) / len(positive)
    return float(np.clip((unlabelled_above / n / np.maximum(kept, 1e-9)).min(), 0.05, 0.99))


def minimise_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, start: np.ndarray, rounds: int = 600, rate: float = 0.02, penalty: float = 1e-3) -> np.ndarray:
    """Adam over the whole sample. Where the negative part falls under zero, the step goes back
    along it instead (the correction of the non-negative risk)."""
    p = np.hstack([positive, np.ones((len(positive), 1))])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1))])
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = -prior * p.T @ sigmoid(-zp) / len(p)
        g_negative = u.T @ sigmoid(zu) / len(u) - prior * p.T @ sigmoid(zp) / len(p)
        g = g_positive + g_negative if negative >= 0 else -g_negative
        g = g + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Model:
    scale: Scale
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(expanded(self.scale(x)) @ self.weights[:-1] + self.weights[-1]) if len(x) else np.zeros(0)


def nothing_known() -> Model:
    """Without positives or without unlabelled rows every text scores the same, one half."""
    return Model(Scale(np.zeros((0, FEATURES))), np.zeros(FEATURES + FEATURES * (FEATURES + 1) // 2 + 1), 0.5)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row, in the shared folder."""

    def work(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "x": [features(t) for t in c["text"]]}

    return cut(map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, x array<double>"))


def _matrix(df: DataFrame) -> np.ndarray:
    return np.array([r["x"] for r in df.select("x").collect()]).reshape(-1, FEATURES)


def train(rows: DataFrame, labels: DataFrame, most_positive: int = MAX_POSITIVE, most_unlabelled: int = MAX_UNLABELLED) -> Model:
    """From the features of all documents (``featured``) and the labels."""
    known = rows.where(F.col("doc_id").isNotNull() & ~held_out())
    positive = _matrix(known.join(F.broadcast(sample_ids(labels.where("quality = 1"), "quality", most_positive)), known["doc_id"] == F.col("id")))
    ids = known.select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_unlabelled).distinct()
    unlabelled = _matrix(known.join(F.broadcast(ids), known["doc_id"] == F.col("id")))
    if not len(positive) or not len(unlabelled):
        return nothing_known()
    column = lambda i: F.element_at("x", i + 1)
    stats = known.agg(F.count("*").alias("n"), *[F.avg(column(i)).alias(f"m{i}") for i in range(FEATURES)], *[F.stddev_pop(column(i)).alias(f"s{i}") for i in range(FEATURES)]).first()
    # rounded: the order in which partial sums meet must not show
    scale = Scale.of(*[np.round([stats[f"{k}{i}"] for i in range(FEATURES)], 9) for k in "ms"])
    p, u = expanded(scale(positive)), expanded(scale(unlabelled))
    apart = logistic(np.vstack([p, u]), np.append(np.ones(len(p)), np.zeros(len(u))), penalty=10.0)
    cuts = prior_cuts(p @ apart[:-1])

    def count(c: dict[str, list]) -> dict[str, list]:
        scores = expanded(scale(np.array(c["x"]).reshape(-1, FEATURES))) @ apart[:-1]
        return {"cut": list(range(len(cuts))), "n": above(scores, cuts).tolist()}

    counted = map_slices(known.select("x"), count, "cut int, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()
    over = np.array([r["n"] for r in sorted(counted, key=lambda r: r["cut"])])
    prior = estimate_prior(p @ apart[:-1], over, stats["n"])
    start = apart.copy()
    start[-1] = np.log(prior / (1 - prior))
    return Model(scale, minimise_risk(p, u, prior, start), prior)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score) of each row of features."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "quality_score": sent.value.score(np.array(c["x"]).reshape(-1, FEATURES))}

    return map_slices(rows.select("doc_id", "x"), work, "doc_id long, quality_score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = featured(table(spark, sf_dir, "documents"))
    out = scored(rows, train(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
