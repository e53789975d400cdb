"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, give_back, need, read, stored, trimmed, words

#: Hashed features, and how many of them a model may weigh.
FEATURES = 1 << 20
CHOSEN = 1 << 14
#: Default bounds of the training sample (see ``train``).
MAX_POSITIVE, MAX_UNLABELLED, MAX_TEXTS = 6_000, 12_000, 8_000
#: How far, in log odds, the prior may move the scores of a fitted model.
MOST_SHIFT = 1.0
#: Lengths of the word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
#: Words whose features a worker remembers; beyond that it starts afresh.
REMEMBERED = 150_000
_EDGE = b".,;:!?\"'()[]{}<>-"


def token_features(token: bytes) -> list[int]:
    """The word without punctuation at its ends, and its beginnings of 4 to 6 bytes, hashed."""
    w = token.strip(_EDGE)
    if not w:
        return []
    return [zlib.crc32(w) % FEATURES] + [zlib.crc32(w[:n], 1) % FEATURES for n in STEMS if len(w) > n]


def document_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text."""
    found: set[int] = set()
    for t in set(words(text)):
        found.update(token_features(t))
    return np.array(sorted(found), np.uint32)


@dataclass
class Model:
    """A logistic classifier over chosen features; ``weights`` is nearly all zero."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        keep = self.weights != 0
        known = dict(zip(self.features[keep].tolist(), self.weights[keep].tolist(), strict=True))
        seen: dict[bytes, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for t in set(words(text)):
                f = seen.get(t)
                if f is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    f = seen[t] = tuple(x for x in token_features(t) if x in known)
                if f:
                    found.update(f)
            g = self.bias + sum(known[x] for x in sorted(found))
            return 1 / (1 + np.exp(-g)) if g > -700 else 0.0

        return score


class Rows:
    """Sparse 0/1 rows; each is an array of column numbers."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.n, self.width = len(rows), width

    def _sums(self, into: np.ndarray, values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
        """A million entries at a time, so that the driver holds no more numbers than the entries themselves."""
        out = np.zeros(n)
        for a in range(0, len(into), 1 << 20):
            out += np.bincount(into[a : a + (1 << 20)], values[by[a : a + (1 << 20)]], n)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.row, w, self.col, self.n)

    def transposed_dot(self, v: np.ndarray) -> np.ndarray:
        return self._sums(self.col, v, self.row, self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative PU risk of scores of positives and unlabelled, and the derivatives that are followed.

    risk = prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), l(g) = log(1 + exp(-g)).
    Where the corrected negative part is below zero its own gradient is followed
    upwards instead of the risk's downwards, as the estimator prescribes.
    """
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    value = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
    neg_p, neg_u = -prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
    if negative >= 0:
        return value, prior * (_sigmoid(gp) - 1) / len(gp) + neg_p, neg_u
    return value, -neg_p, -neg_u


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], features: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, lasso: float = 2e-4) -> Model:
    """Minimise the non-negative PU ``risk`` of a linear model; rows hold places in ``features``.

    Steps are Adam with a proximal step that zeroes small weights.
    """
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    xp, xu = Rows(positive, len(features)), Rows(unlabelled, len(features))
    w, b = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for k in range(1, rounds + 1):
        _, by_p, by_u = risk(xp.dot(w) + b, xu.dot(w) + b, prior)
        grad = np.concatenate([xp.transposed_dot(by_p) + xu.transposed_dot(by_u), [by_p.sum() + by_u.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        shrink = rate * lasso / (np.sqrt(v[:-1] / (1 - 0.999**k)) + 1e-8)
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(shrink, rate))
    return Model(features, w, float(b))


def mean_model(one: Model, other: Model) -> Model:
    """The model whose log odds are the mean of those of two."""
    features = np.union1d(one.features, other.features)
    weights = np.zeros(len(features))
    for m in (one, other):
        weights[np.searchsorted(features, m.features)] += m.weights / 2
    return Model(features, weights, (one.bias + other.bias) / 2)


def shift_to_prior(scores: np.ndarray, prior: float, threshold: float) -> float:
    """What to add to log odds so that a share ``prior`` of them reaches the threshold; at most ``MOST_SHIFT`` either way."""
    if not len(scores):
        return 0.0
    least = np.sort(scores)[min(len(scores) - 1, int(round(len(scores) * (1 - prior))))]
    return float(np.clip(np.log(threshold / (1 - threshold)) - least, -MOST_SHIFT, MOST_SHIFT))


def _sample(texts: DataFrame, marks: DataFrame, max_positive: int, max_unlabelled: int, max_texts: int) -> DataFrame:
    """``(doc_id, p, u, t, f)``: features of the documents to learn from, by id, and what each is: a positive, one of ``marks``, any text.

    Ids are chosen without their texts, by smallest hash; one may be chosen for more than one part.  Of
    rows that share an id the one of smallest features counts.
    """
    choose = lambda df, most, salt: df.select("doc_id", F.xxhash64(F.lit(salt), "doc_id").alias("o")).orderBy("o").limit(most).select("doc_id", F.lit(salt).alias("what"))
    anything = texts.where("doc_id IS NOT NULL").select("doc_id").distinct()
    picked = choose(marks.where("y = 1"), max_positive, "p").unionAll(choose(marks, max_unlabelled, "u")).unionAll(choose(anything, max_texts, "t"))
    ids = stored(picked.groupBy("doc_id").agg(*[F.max((F.col("what") == x).cast("int")).alias(x) for x in "put"]), "tox-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([document_features(t.as_py()).tobytes() for t in b.column(4)], pa.binary())], ["doc_id", *"put", "f"])

    # The bounds of the sample bound what is broadcast.
    rows = texts.join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("string"), *"put", "text").mapInArrow(trimmed(run), "doc_id string, p int, u int, t int, f binary")
    return stored(rows.groupBy("doc_id", *"put").agg(F.min("f").alias("f")), "tox-sample")


def _standing_out(sample: DataFrame, other: str, np_: int, nu: int) -> np.ndarray:
    """The features whose share among the positives stands out most from that among the rows of kind ``other``, by a chi-square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, u = np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.int32)
        for b in batches:
            for is_p, is_u, f in zip(b.column("p"), b.column(other), b.column("f"), strict=True):
                own = np.frombuffer(f.as_buffer(), np.uint32)
                p[own] += is_p.as_py()
                u[own] += is_u.as_py()
        got = np.flatnonzero(p | u)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (got, p[got], u[got])], ["feature", "p", "u"])

    counts = sample.mapInArrow(trimmed(run), "feature int, p int, u int").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 5")
    pool = (F.col("p") + F.col("u")) / F.lit(np_ + nu)
    z = F.pow(F.col("p") / F.lit(np_) - F.col("u") / F.lit(nu), 2) / F.greatest(pool * (1 - pool), F.lit(1e-12)) * F.lit(np_ * nu / (np_ + nu))
    best = counts.select("feature", z.alias("z")).where("z > 6.6").orderBy(F.desc("z"), "feature").limit(CHOSEN)
    return np.array(sorted(r["feature"] for r in best.select("feature").collect()), np.int64)  # CHOSEN rows at most


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_texts: int = MAX_TEXTS, threshold: float = 0.3) -> Model:
    """Learn from documents confirmed toxic in ``labels`` and from text without regard to its labels.

    Two linear models are fitted to the same positives, one against documents of ``labels`` with their
    labels ignored, one against any text; the log odds of the result are their mean,
    shifted so that of the any-text rows a share equal to the class prior reaches ``threshold``.
    The sample is bounded by parameters: ``max_positive`` confirmed documents, ``max_unlabelled``
    of ``labels`` and ``max_texts`` of any, those of smallest hash of the id.  Where ``labels``
    knows toxic documents only, any text stands for both.  Labelled negatives are used for
    the class prior alone (the share of 1 among all labels given), unless ``prior`` is
    given.  Of rows that share an id one is learned from; of labels that disagree the
    larger counts; null ids and labels are ignored.  Features are computed and counted
    in the tasks; at most twice 16,384 of them and the sample's places in them reach the driver.
    """
    texts = need(docs, (id_col, text_col)).toDF("doc_id", "text")
    marks = stored(need(labels, (id_col, label_col)).toDF("doc_id", "y").where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")), "tox-marks")
    if prior is None:
        share = marks.agg(F.avg((F.col("y") == 1).cast("double")).alias("p")).first()["p"]
        prior = min(0.9, max(1e-4, share)) if share is not None else 1e-4
    pools = ("u", "t") if not marks.where("y <> 1").isEmpty() else ("t",)
    sample = _sample(texts, marks, max_positive, max_unlabelled, max_texts)
    size = sample.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "put"]).first()
    pools = [x for x in pools if size[x]]
    if not size["p"] or not pools:
        return fit([], [], np.zeros(0, np.int64), prior)
    chosen = {x: _standing_out(sample, x, size["p"], size[x]) for x in pools}
    every = np.unique(np.concatenate(list(chosen.values())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(FEATURES, -1, np.int32)
        at[every] = np.arange(len(every))
        for b in batches:
            rows = [(m := at[np.frombuffer(f.as_buffer(), np.uint32)])[m >= 0].astype(np.uint16).tobytes() for f in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rows, pa.binary())], ["doc_id", *"put", "f"])

    got = sample.mapInArrow(trimmed(place), "doc_id string, p int, u int, t int, f binary").orderBy("doc_id").collect()  # the sample's bounds

    def rows(kind: str, features: np.ndarray) -> list[np.ndarray]:
        own = np.full(len(every), -1, np.int32)
        own[np.searchsorted(every, features)] = np.arange(len(features))
        return [(m := own[np.frombuffer(r["f"], np.uint16)])[m >= 0] for r in got if r[kind]]

    fitted = [fit(rows("p", f), rows(x, f), f, prior) for x, f in chosen.items()]
    model = fitted[0] if len(fitted) == 1 else mean_model(*fitted)
    any_text = Rows(rows("t", model.features), len(model.features))
    model.bias += shift_to_prior(any_text.dot(model.weights) + model.bias, prior, threshold)
    del got, any_text
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; a null or empty text has the score of no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            s = np.array([score(t.as_py()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return need(docs, (id_col, text_col)).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(bucket(doc_id, 4) == 2, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text.

    Rows whose crc32 of the id leaves remainder 2 by 4 are held out: neither their
    labels nor their texts are learned from.  Only the text enters a score.  Null
    and empty texts get the score of a text without features; repeated rows get the
    same score; rows without id are scored and count as not held out.  Without
    positive labels the score is the prior.  An empty table gives an empty result.
    """
    model = train(docs.where(~held_out()), labels.where(~held_out()), threshold=threshold)
    return score_toxicity(docs, model, threshold=threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay.

    Rows are judged by their text alone, so ids may repeat or be null; null and empty
    texts get the score of a text without features.  Training is as in
    ``toxicity_scores``.  An empty table stays empty.
    """
    model = train(docs.where(~held_out()), labels.where(~held_out()), threshold=threshold)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        at = names.index(text_col)
        for b in batches:
            keep = np.array([score(t.as_py()) < threshold for t in b.column(at)], bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns], schema=b.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
