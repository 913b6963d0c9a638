"""Toxic passages as maximum-scoring segments of token log-odds, and a calibrated score per document.

Learning. Tokens (lower-cased letters and digits) are hashed into ``BUCKETS`` buckets. Their log-odds between toxic and
other labelled documents are smoothed by a Dirichlet prior with the token shares of the whole corpus, and count only if
they lie ``MIN_Z`` standard errors from zero. Counting is a distributed sum whose result has at most ``BUCKETS`` rows.

Search. Every token scores its log-odds less a small drift, so a text without evidence scores below zero. The
linear-time scan of Ruzzo and Tompa gives all maximal segments. By extreme-value theory a text of n tokens has K n exp(-lambda S)
segments of score S or more by chance; lambda solves sum p exp(lambda s) = 1 over the tokens of the corpus, K is
fitted to the best segments of those documents. Segments with an expectation of at most ``MAX_CHANCE`` are passages.

Score. A logistic curve over the best score normalised by extreme-value theory and the sum, number and density of the strong
segments, fitted to at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id. Rows without text score like texts without evidence.

Null labels and labels of unknown ids are ignored; repeated labels count once each. Null texts are empty. With no label of
one kind the score is the share of toxic labels. Every row of the documents gives one row; empty tables give none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import text_slices
from claimspark.session import bounded, checkpoint

BUCKETS = 1 << 18
PRIOR_TOKENS = 20_000.0
MIN_Z = 3.0
DRIFT = 0.1
MAX_CHANCE = 0.05
STRONG = 4.0  # score of the segments that are summed over a document
FIT_ROWS = 200_000
BROADCAST_LABELS = 1_000_000  # rows of id and label, 16 MB
CACHE_WORDS = 500_000
TOKEN = re.compile(r"[^\W_]+")

_known: dict[str, int] = {}


def token_buckets(text: str | None, buckets: int) -> np.ndarray:
    words = TOKEN.findall((text or "").lower())
    if len(_known) > CACHE_WORDS:
        _known.clear()
    out = []
    for w in words:
        b = _known.get(w)
        if b is None:
            b = _known[w] = zlib.crc32(w.encode("utf-8", "replace"))
        out.append(b)
    return np.array(out, dtype=np.int64) % buckets


def token_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, n, n_toxic, n_other (tokens) over documents (text, toxic: null where not for learning)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, buckets), dtype=np.int64)
        for batch in text_slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = token_buckets(text, buckets)
                np.add.at(sums[0], tokens, 1)
                if toxic is not None:
                    np.add.at(sums[1 if toxic else 2], tokens, 1)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(row[used]) for row in sums]], names=["bucket", "n", "n_toxic", "n_other"])

    return docs.select("text", "toxic").mapInArrow(run, "bucket long, n long, n_toxic long, n_other long") \
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "n_toxic", "n_other")])


@dataclass
class Model:
    scores: np.ndarray  # per bucket, drift included
    drift: float
    rate: float  # lambda
    log_k: float = 0.0

    @classmethod
    def of(cls, counts: np.ndarray, prior_tokens: float = PRIOR_TOKENS, min_z: float = MIN_Z, drift: float = DRIFT) -> Model:
        """From the rows n, n_toxic, n_other per bucket."""
        n, toxic, other = (row.astype(float) for row in counts)
        if not toxic.sum() or not other.sum():
            return cls(np.full(len(n), -drift), drift, 1.0)
        prior = prior_tokens * (n + 1e-3) / (n + 1e-3).sum()
        odds = lambda y: np.log((y + prior) / (y.sum() + prior_tokens - y - prior))
        delta = odds(toxic) - odds(other)
        z = delta / np.sqrt(1 / (toxic + prior) + 1 / (other + prior))
        delta[np.abs(z) < min_z] = 0.0
        share = n / n.sum()
        drift = max(drift, 2 * float(share @ delta))
        scores = delta - drift
        low, high = 0.0, 1.0
        moment = lambda rate: float(share @ np.exp(np.minimum(rate * scores, 500))) - 1
        while moment(high) < 0 and high < 50:
            low, high = high, 2 * high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if moment(mid) < 0 else (low, mid)
        return cls(scores, drift, max(high, 1e-3))

    def segments(self, tokens: np.ndarray) -> list[tuple[float, int, int]]:
        """(score, first, end) of all maximal segments of positive score, by a scan that touches every token once."""
        s = self.scores[tokens]
        odd = np.flatnonzero(s != -self.drift)
        # Sum left of it, sum to its end, first, end, and the nearest entry below with a lower left sum. What a step passes over
        # lies behind the new entry's link or is removed, so no entry is passed twice.
        stack: list[tuple[float, float, int, int, int]] = []
        total, last = 0.0, -1
        for at, score in zip(odd.tolist(), s[odd].tolist()):
            total -= self.drift * (at - last - 1)
            last = at
            if score <= 0:
                total += score
                continue
            left, right, first = total, total + score, at
            total = right
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][0] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][1] >= right:
                    break
                left, first, below = stack[j][0], stack[j][2], stack[j][4]
                del stack[j:]
                j = below
            stack.append((left, right, first, at + 1, j))
        return [(right - left, first, end) for left, right, first, end, _ in stack]


SEGMENTS = ("doc_id long, n_tokens long, best double, strong double, n_strong long, score double, "
            "passages array<struct<first:long,end:long,score:double>>")


def curve(rate: float, n: np.ndarray, best: np.ndarray, strong: np.ndarray, n_strong: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of a document."""
    tokens = np.maximum(n, 1)
    return np.column_stack([rate * best - np.log(tokens), np.minimum(best, 50.0), best > 0, np.minimum(strong, 100.0), np.log1p(n_strong), strong / tokens, np.log(tokens)])


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ weights, -30, 30)))


def passage_features(docs: DataFrame, model: Model, buckets: int, max_chance: float, weights: np.ndarray | None = None, default: float = 0.0) -> DataFrame:
    """Per row: number of tokens, best segment score, sum and number of strong segments, the calibrated score (``default``
    without weights), and the passages that chance does not explain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_slices(batches):
            n, best, strong, n_strong, passages = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = token_buckets(text, buckets)
                found = m.segments(tokens) if len(tokens) else []
                bound = (m.log_k + math.log(len(tokens)) - math.log(max_chance)) / m.rate if len(tokens) else 0.0
                kept = [x for x in found if x[0] >= bound]
                n.append(len(tokens))
                best.append(max((x[0] for x in found), default=0.0))
                strong.append(sum(x[0] for x in found if x[0] >= STRONG))
                n_strong.append(sum(x[0] >= STRONG for x in found))
                passages.append([{"first": f, "end": e, "score": round(x, 6)} for x, f, e in kept])
            score = np.full(len(n), default) if weights is None else logistic(curve(m.rate, *(np.array(c, dtype=float) for c in (n, best, strong, n_strong))), weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(strong, pa.float64()), pa.array(n_strong, pa.int64()), pa.array(np.round(score, 9)), pa.array(passages, passage)],
                names=["doc_id", "n_tokens", "best", "strong", "n_strong", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, SEGMENTS)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-regularised logistic curve by Newton's method; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, buckets: int = BUCKETS, prior_tokens: float = PRIOR_TOKENS,
                    min_z: float = MIN_Z, max_chance: float = MAX_CHANCE, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, best and passages of every row of ``docs``.

    ``held_out`` is a condition on doc_id; labels of such rows are never read.
    """
    held_out = F.lit(False) if held_out is None else held_out
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    side = F.broadcast(known) if bounded(known, BROADCAST_LABELS) else known
    counts = np.zeros((3, buckets), dtype=np.int64)
    for row in token_counts(d.join(side, "doc_id", "left"), buckets).toArrow().to_batches():  # at most ``buckets`` rows
        counts[:, row.column(0).to_numpy()] = [row.column(i).to_numpy() for i in (1, 2, 3)]
    model = Model.of(counts, prior_tokens, min_z)

    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    small = F.broadcast(sample) if bounded(sample, BROADCAST_LABELS) else sample
    fitted = passage_features(d.join(small.select("doc_id"), "doc_id", "left_semi"), model, buckets, max_chance).dropDuplicates(["doc_id"])
    seen = fitted.join(small, "doc_id").select("n_tokens", "best", "strong", "n_strong", "toxic").toArrow()  # at most ``fit_rows`` rows
    n, best, strong, n_strong, toxic = (seen.column(i).to_numpy().astype(float) for i in range(5))
    normal = (toxic == 0) & (n > 0) & (best > 0)
    if normal.any():
        # the mean of a Gumbel variable is its mode plus Euler's constant
        model.log_k = float(np.mean(model.rate * best[normal] - np.log(n[normal])) - 0.5772156649)
    share = float(toxic.mean()) if len(toxic) else 0.0
    weights = logistic_fit(curve(model.rate, n, best, strong, n_strong), toxic) if 0 < share < 1 else None
    f = checkpoint(passage_features(d, model, buckets, max_chance, weights, share), "toxicity")
    return f.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "best", "passages")
