"""Toxic passages as maximum-scoring segments, with extreme-value significance.

A feature is a word or one of its beginnings (languages inflect). Its score is its log odds, by
documents that hold it, in toxic against other labelled documents, under a Dirichlet prior with
the proportions of the whole corpus, less ``Z`` standard errors, so that only well-supported
features count. A token scores as its best feature, less a cost of ``GAP``, so that scores fall on
ordinary text: many common words lean to one label a little, if only because documents of one
label are longer, and without the cost long texts would add them up to more than a passage. One linear scan of a document finds all its maximal-scoring segments (Ruzzo and
Tompa). In text without toxic passages the number of segments of at least a score s in n tokens
is about Poisson with mean K n exp(-lambda s) (Karlin and Altschul); K and lambda are fitted to
the segments of labelled other documents. A document's evidence is the least
tail probability over its r best segments, and a logistic curve, fitted on a bounded histogram
of all training documents, turns it into a score from 0 to 1.

Features are counted in ``BINS`` hashed bins, so the tables of counts and scores have a fixed
bound, whatever the vocabulary; only well-supported bins come to the driver and go out again.

Null texts and texts without tokens have no segments and get the score of no evidence. Only
labels of training rows are read: those whose crc32 of the id as text leaves a remainder other
than 0 modulo ``FOLDS``. Several labels of one id count as the highest; null ones are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.session import settle

BINS = 1 << 20
BEGINNINGS = (4, 6, 8)  # bytes
FOLDS = 5
MARKS = 1 << 23  # bits
PRIOR_DOCS = 50.0  # weight of the prior, in documents
Z = 3.0
GAP = 0.5  # in log odds; weaker features lower a passage's score
CACHE_TOKENS = 250_000
NO_EVIDENCE = -1.0  # highest log odds of a document without any evidence
STEP, MOST = 0.05, 10.0  # bins of log(1 + evidence) for the logistic fit
EDGE = ".,;:!?\"'()[]{}<>*#%$&|-_"


def features(token: str) -> tuple[int, ...]:
    """Bins of a word's beginnings and of the word itself. Each checksum goes on from the one
    of the shorter beginning."""
    word = token.strip(EDGE).encode("utf-8", "replace")
    bins, sum_, at = [], 0, 0
    for k in BEGINNINGS:
        if k > len(word):
            break
        sum_, at = zlib.crc32(word[at:k], sum_), k
        bins.append(sum_ % BINS)
    bins.append(zlib.crc32(word[at:] + b"\0", sum_) % BINS)
    return tuple(bins)


class Known(dict):
    """A value for each token met; starts anew once full, so its memory is bounded."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, token: str):
        value = self.make(token)
        if len(self) >= CACHE_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = value
        return value


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def held_out(id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string")) % FOLDS == 0


def training(labels: DataFrame, id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """_id and toxic of the rows that may be learned from."""
    return labels.where(~held_out(id) & F.col(label).isNotNull()).groupBy(
        F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))


def _counted(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """bin, and for each of ``kinds`` the documents of that kind with the feature. Rows are text
    and kind, a number. Bin -1 counts all documents."""
    schema = "bin bigint, " + ", ".join(f"{k} bigint" for k in kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = Known(features), np.zeros((len(kinds), BINS), dtype=np.int32)
        whole = np.zeros(len(kinds), dtype=np.int64)
        for pdf in batches:
            for t, kind in zip(pdf["text"], pdf["kind"], strict=True):
                bins = set().union(*map(known.__getitem__, set(tokens_of(t))))
                counts[kind, np.fromiter(bins, dtype=np.int64, count=len(bins))] += 1
                whole[kind] += 1
        yield pd.DataFrame({"bin": [-1]} | {k: [n] for k, n in zip(kinds, whole, strict=True)})
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 100_000):
            b = used[at:at + 100_000]
            yield pd.DataFrame({"bin": b} | {k: counts[n, b] for n, k in enumerate(kinds)})

    return rows.mapInPandas(run, schema).groupBy("bin").agg(*[F.sum(k).alias(k) for k in kinds])


def maybe_labelled(docs: DataFrame, train: DataFrame, id: str) -> DataFrame:
    """The documents whose id falls on a set bit of a bitmap of the training ids: all training
    documents, and by chance a few others. The bitmap has ``MARKS`` bits whatever the number of
    labels, so its broadcast is bounded; it only spares the shuffle of unlabelled texts."""
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(MARKS))

    marks = train.select(place("_id").alias("_p")).groupBy(
        F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.expr(
            "shiftleft(1L, int(_p & 63))")).alias("_bits"))
    rows = docs.withColumn("_p", place(id))
    set_ = F.expr("(shiftrightunsigned(_bits, int(_p & 63)) & 1L) = 1L")
    return rows.join(F.broadcast(marks), (F.shiftright("_p", 6) == F.col("_word")) & set_,
                     "left_semi").drop("_p")


def feature_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """bin, corpus, toxic, other: documents with the feature, in the whole corpus and among
    labelled training ones. Bin -1 counts all documents. Texts are shuffled only where they may
    be labelled, and by the same join at every size."""
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).alias("text"))
    train = settle(training(labels), "training")
    corpus = _counted(rows.select("text", F.lit(0).alias("kind")), ("corpus",))
    learned = maybe_labelled(rows, train, "_doc").join(
        train.hint("merge"), F.col("_doc") == F.col("_id")).select(
        "text", F.when(F.col("toxic") > 0, 0).otherwise(1).alias("kind"))
    classes = _counted(learned, ("toxic", "other"))
    return corpus.join(classes, "bin", "left").select("bin", "corpus", *[
        F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("toxic", "other")])


@dataclass(frozen=True)
class Scores:
    """Scores of the well-supported features."""

    bins: np.ndarray
    values: np.ndarray


def feature_scores(counts: DataFrame) -> Scores:
    """Scores from the counts, at most ``BINS`` rows, of which only supported ones are
    fetched."""
    counts = settle(counts, "feature-counts")
    whole = counts.where("bin < 0").first()
    none = Scores(np.zeros(0, dtype=np.int64), np.zeros(0))
    if whole is None or not whole["toxic"] or not whole["other"]:
        return none
    n, toxic, other = (float(whole[c]) for c in ("corpus", "toxic", "other"))
    a = F.col("corpus") * (PRIOR_DOCS / (n + 1))
    t, o = F.col("toxic") + a, F.col("other") + a
    odds = F.log(t / (toxic + PRIOR_DOCS - t)) - F.log(o / (other + PRIOR_DOCS - o))
    error = F.sqrt(1 / t + 1 / o)
    kept = counts.where("bin >= 0").select(
        "bin", odds.alias("odds"), (Z * error).alias("margin")).where("abs(odds) > margin").select(
        "bin", F.expr(f"sign(odds) * (abs(odds) - margin) - {GAP}").alias("score")
    ).orderBy("bin").toPandas()
    return Scores(kept["bin"].to_numpy(), kept["score"].to_numpy())


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, left to right, in linear time.

    Only tokens of positive score can start one, so the scan steps from one to the next and
    takes the sum between from prefix sums.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    starts, ends, left, right, back = [], [], [], [], []
    for i, low, high in zip(up.tolist(), (total[up] - scores[up]).tolist(), total[up].tolist(),
                            strict=True):
        start = i
        while True:
            # Nearest earlier segment whose left sum is smaller; those between are passed over
            # for good by the chain of links.
            j = len(starts) - 1
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            start, low = starts[j], left[j]
            del starts[j:], ends[j:], left[j:], right[j:], back[j:]
        starts.append(start)
        ends.append(i + 1)
        left.append(low)
        right.append(high)
        back.append(j)
    return [(s, e, r - a) for s, e, a, r in zip(starts, ends, left, right, strict=True)]


SEGMENTS = "n bigint, segments array<struct<start:bigint,end:bigint,score:double>>"


def passages(docs: DataFrame, scores: Scores, id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """doc_id, n (tokens) and segments: all maximal-scoring segments, in token positions."""
    bins, weights = scores.bins, scores.values

    def make():
        table = dict(zip(bins.tolist(), weights.tolist(), strict=True))
        known = Known(lambda token: max(table.get(b, -GAP) for b in features(token)))

        def compute(batch: pa.RecordBatch) -> tuple:
            n, found = [], []
            for t in batch.column("text").to_pylist():
                tokens = tokens_of(t)
                n.append(len(tokens))
                values = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
                found.append([{"start": s, "end": e, "score": x}
                              for s, e, x in maximal_segments(values)])
            return n, found

        return compute

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return computed(rows, ["doc_id"], SEGMENTS, make)


def evidence(n: int, segment_scores: list[float], decay: float, rate: float) -> float:
    """Minus log of the least tail probability over the r best segments: that of r or more
    segments as good as the r-th in n ordinary tokens. No segments: 0."""
    best = 0.0
    if not n:
        return best
    for r, s in enumerate(sorted(segment_scores, reverse=True), 1):
        log_mean = math.log(rate * n) - decay * s
        if log_mean > math.log(r):
            continue
        mean = math.exp(log_mean)
        # Poisson tail from r on: its first term times a geometric bound of the rest.
        log_tail = r * log_mean - mean - math.lgamma(r + 1) - math.log1p(-min(
            mean / (r + 1), 0.999999))
        best = max(best, -log_tail)
    return best


def with_evidence(found: DataFrame, decay: float, rate: float) -> DataFrame:
    """doc_id and evidence of stored passages."""

    def make():
        return lambda batch: ([evidence(n, [s["score"] for s in segments], decay, rate) for n, segments in zip(
            batch.column("n").to_pylist(), batch.column("segments").to_pylist(), strict=True)],)

    return computed(found, ["doc_id"], "evidence double", make)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a ridge-penalised logistic curve over counted points, both labels with
    the same total weight: 0.5 is where a document is as likely under one as under the other, however
    rare toxic ones are. Newton steps are halved until they lower the loss, so none runs away."""
    n = n * np.where(y == 1, 1 / n[y == 1].sum(), 1 / n[y == 0].sum()) * n.sum() / 2
    design = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.array([0.0, 0.01])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (n * (y - p)) - ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.01])
        step = np.linalg.solve(hessian, gradient)
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on), and evidence of every
    document. Without labels of both kinds nothing is learned and all scores are 0."""
    scores = feature_scores(feature_counts(docs, labels, id, text))
    found = settle(passages(docs, scores, id, text), "passages")
    train = settle(training(labels), "training")
    learned = found.join(train, F.col("doc_id") == F.col("_id"))
    plain = learned.where("toxic = 0")
    n = plain.agg(F.sum("n")).first()[0] or 0
    scores_ = F.transform("segments", lambda s: s["score"])
    total, count = plain.agg(
        F.sum(F.aggregate(scores_, F.lit(0.0), lambda acc, s: acc + s)),
        F.sum(F.size("segments"))).first()
    # Scores of ordinary segments fall off exponentially; one added to each sum keeps both
    # finite where there are none.
    decay = ((count or 0) + 1.0) / ((total or 0.0) + 1.0)
    rate = ((count or 0) + 1.0) / (n + 1.0)
    known = settle(with_evidence(found, decay, rate), "evidence")
    # On a log scale a few mislabelled documents of great evidence do not flatten the curve.
    step = F.floor(F.least(F.log1p("evidence"), F.lit(MOST)) / STEP)
    points = known.join(train, F.col("doc_id") == F.col("_id")).groupBy(
        step.alias("x"), "toxic").count().orderBy("x", "toxic").toPandas()
    a, b = (logistic(points["x"].to_numpy() * STEP, (points["toxic"] > 0).to_numpy().astype(float),
                     points["count"].to_numpy().astype(float))
            if points["toxic"].gt(0).nunique() == 2 else (-800.0, 0.0))
    # Where no feature is supported the curve is flat at one half; nothing speaks for toxic there.
    a = min(a, NO_EVIDENCE)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * step * STEP)))
    return known.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
                        "evidence")


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The documents, all columns, that are not predicted toxic. Rows with equal ids go together
    if any is toxic; rows with a null id stay."""
    bad = scored(docs, labels, id, text).where("predicted = 1").select(
        F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id] == bad["_bad"], "left_anti")
