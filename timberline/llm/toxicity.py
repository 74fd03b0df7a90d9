"""Non-negative positive-unlabelled learning of toxic text.

Confirmed toxic texts are the positives; texts drawn regardless of their label are the unlabelled ones. The classifier is
logistic in the presence of words and word starts, and minimises the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]),

stepping back up whenever the second term turns negative. Features are those whose share among the positives exceeds
their share among the unlabelled by far more than chance. Training runs over a bounded sample of labelled rows
(some ``positives`` and ``unlabelled`` rows, chosen by a hash of the id); every document is scored, whole.

Defined results: null or empty text has no feature and gets the score of the intercept. Without confirmed toxic rows
every score is 0. A null id isn't held out. Extra columns are ignored; repeated rows are scored each. Empty table: empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pin, unpin

#: Lengths of word starts that are features beside the word itself.
STARTS = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’¡¿*#$%&|_-–—"


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word without punctuation at its ends, and of its starts."""
    word = word.strip(EDGES)
    if not word:
        return ()
    parts = [word] + [f"{word[:k]}*" for k in STARTS if len(word) >= k]
    return tuple(xxhash.xxh32_intdigest(p) for p in parts)


class _Known(dict):
    """Word -> what ``of`` makes of it; emptied when it gets large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        value = self[word] = self.of(word)
        return value


_features = _Known(word_features)


def text_features(text: str | None) -> np.ndarray:
    words = set(text.lower().split()) if text else ()
    found = {f for fs in map(_features.__getitem__, words) for f in fs}
    return np.fromiter(sorted(found), np.uint32, len(found))


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    intercept: float

    def scorer(self):
        """A function text -> score that remembers which words matter."""
        weights = self.weights
        known = _Known(lambda word: tuple(f for f in word_features(word) if f in weights))

        def score(text: str | None) -> float:
            z = self.intercept
            if text:
                hits = {f for fs in map(known.__getitem__, set(text.lower().split())) if fs for f in fs}
                z += sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

        return score


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3):
    """Weights and intercept, by Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    grad = lambda x, r: np.append(x.T @ r, r.sum()) / max(len(x), 1)
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        minus_u, minus_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
        negative = grad(xu, sigmoid(zu)) - prior * grad(xp, sigmoid(zp))
        g = prior * grad(xp, sigmoid(zp) - 1) + negative if minus_u - prior * minus_p >= 0 else -negative
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _featurised(batches):
    for batch in batches:
        found = [text_features(t).astype(np.int64) for t in batch.column("text").to_pylist()]
        columns = [batch.column(c) for c in ("place", "positive", "drawn")] + [pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "positive", "drawn", "features"])


def draw(labels: DataFrame, most: int, rows: int) -> DataFrame:
    """About 95 % of ``most`` of the rows, or all if there are no more, by a hash of the id: no row is sent or sorted to choose it."""
    share = min(1.0, 0.95 * most / max(rows, 1)) if rows > most else 1.0
    return labels.where(F.col("place") < int(share * 2**40))


def chosen_features(sample: DataFrame, positives: int, unlabelled: int, most: int) -> list[int]:
    """Features whose share among the positives is the most significantly above that among the unlabelled; at most ``most``."""
    counts = sample.select("positive", "drawn", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("n_pos"), F.count_if("drawn").alias("n_unl")
    )
    p, u = F.col("n_pos") / positives, (F.col("n_unl") + 1) / (unlabelled + 2)
    z = (p - u) / F.sqrt(u * (1 - u) * (1 / positives + 1 / unlabelled))
    good = counts.withColumn("z", z).where((z > 4) & (p > 3 * u) & (F.col("n_pos") >= 3))
    return sorted(r.feature for r in good.orderBy(F.desc("z"), "feature").limit(most).collect())


def learn(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 8000, most_features: int = 512) -> Model:
    """Trains on at most ``positives`` confirmed rows and ``unlabelled`` rows drawn whatever their label.

    Features are counted by Spark; the driver gets at most ``most_features`` of them and, of each row of the sample, which
    of these it has, in the order of a hash of the ids.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"))
    labels = labels.where("doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(2**40)))
    rows, toxic = labels.agg(F.count("*"), F.count_if("toxic")).first()
    if not rows or not toxic:
        return Model({}, -40.0)
    drawn = draw(labels, unlabelled, rows).select("doc_id", "place", F.lit(False).alias("positive"), F.lit(True).alias("drawn"))
    confirmed = draw(labels.where("toxic"), positives, toxic).select("doc_id", "place", F.lit(True).alias("positive"), F.lit(False).alias("drawn"))
    chosen = drawn.union(confirmed).groupBy("doc_id", "place").agg(F.max("positive").alias("positive"), F.max("drawn").alias("drawn"))
    # Some positives + unlabelled rows of four small columns: the bound doesn't depend on the corpus.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "place", "positive", "drawn", "text").dropDuplicates(["doc_id"])
    sample = pin(sample.mapInArrow(_featurised, "place long, positive boolean, drawn boolean, features array<long>"))
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if("drawn")).first()
    if not n_pos or not n_unl:
        return Model({}, -40.0)
    features = chosen_features(sample, n_pos, n_unl, most_features)
    mine = F.array_intersect("features", F.array(*(F.lit(f) for f in features)).cast("array<long>"))
    rows_of = sorted(sample.select("place", "positive", "drawn", mine.alias("features")).collect(), key=lambda r: (r.place, sorted(r.features)))
    unpin(sample)
    at = {f: k for k, f in enumerate(features)}
    x = np.zeros((len(rows_of), len(features)), np.float32)
    for k, r in enumerate(rows_of):
        x[k, [at[f] for f in r.features]] = 1
    positive, unl = (np.array([r[c] for r in rows_of], bool) for c in ("positive", "drawn"))
    w, b = fit_nnpu(x[positive], x[unl], min(toxic / rows, 0.99))
    return Model({int(f): float(v) for f, v in zip(features, w)}, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            scores = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            fine = [scorer(t) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
