"""Toxicity scores learned from confirmed toxic examples and unlabelled text.

Unlabelled text holds toxic text too, at a known share (the class prior). The risk of
a classifier is therefore estimated without negative examples: the loss of the positives
as positives, weighted by the prior, plus the loss of the unlabelled as negatives less
the part of it that the positives explain. That second part may not fall below
zero; where it does, training steps back (non-negative risk). Several linear
classifiers on hashed words are trained and averaged. They learn from the words that positives hold
clearly more often than unlabelled text; the rest cannot be told from chance in a sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import ALNUM, LOWER, SpanHash, byte_values, map_text, text_blocks, word_bounds

#: Hashed features.
FEATURES = 1 << 18


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample, and the training itself."""

    max_positive: int = 3000
    max_unlabelled: int = 9000
    models: int = 3
    steps: int = 120
    rate: float = 0.1
    decay: float = 1e-4
    #: Only features of so many positives are learned,
    min_texts: int = 4
    #: and only those above the unlabelled share by so many standard errors.
    min_excess: float = 5.0


@dataclass
class Model:
    """Weights by feature and a bias; ``prior`` is the score without any evidence to learn from."""

    bias: float
    weights: np.ndarray = field(repr=False)


def features(data: np.ndarray, starts: np.ndarray):
    """Distinct hashed words of each row as ``(rows, features)``, rows ascending."""
    lower = LOWER[data]
    begins, ends, row = word_bounds(lower, starts, ALNUM)
    word = (SpanHash(byte_values(lower))(begins, ends) % np.uint64(FEATURES)).astype(np.int64)
    key = np.unique(row * FEATURES + word)
    return key // FEATURES, key % FEATURES


def in_fold(doc_id, folds: int = 5):
    """Remainder of the CRC-32 of an id as text; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def _sample(docs: DataFrame, share: float, salt: int, most: int) -> DataFrame:
    """Rows below a hash threshold, about ``most`` and at most twice as many."""
    part = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
    return docs.where(part).limit(2 * most)


def _hashed(docs: DataFrame) -> list[np.ndarray]:
    """Features of each row of a bounded sample."""
    def start():
        def work(batch):
            out = [b""] * batch.num_rows
            for first, rows, data, starts in text_blocks(batch, "text"):
                row, feature = features(data, starts)
                cut = np.searchsorted(row, np.arange(rows + 1))
                for r in range(rows):
                    out[first + r] = feature[cut[r]:cut[r + 1]].astype(np.int32).tobytes()
            return [out]

        return work

    rows = map_text(docs.select("text"), start, "features binary", []).collect()
    # Sorted, so that the order in which tasks end does not matter.
    return [np.frombuffer(r, np.int32) for r in sorted(bytes(r[0]) for r in rows)]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = 5) -> Model:
    """Train on the ids outside fold 0; labels of that fold are never read.

    The sample is bounded by ``settings``. The class prior is the toxic share of all labelled ids of the training folds.
    Without confirmed examples or unlabelled text, the model scores everything 0.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where((in_fold("doc_id", folds) != 0) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic).alias("toxic")).where((in_fold("doc_id", folds) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known, positive = labels.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    total = docs.count()
    if not positive or not total:
        return Model(-40.0, np.zeros(FEATURES, np.float32))
    chosen = labels.where("toxic = 1").select("doc_id").distinct()
    chosen = chosen.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(min(1.0, settings.max_positive / positive) * (1 << 30))).limit(2 * settings.max_positive)
    # At most twice the bound of ids, so their list may be sent to every task.
    toxic_docs = docs.join(F.broadcast(chosen), "doc_id", "left_semi").limit(2 * settings.max_positive)
    return train(_hashed(toxic_docs), _hashed(_sample(docs, settings.max_unlabelled / total, 2, settings.max_unlabelled)), positive / known, settings)


def _csr(rows: list[np.ndarray], remap: np.ndarray):
    """Features of rows as one array, and the row of each."""
    column = remap[np.concatenate([np.zeros(0, np.int32), *rows])]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return column[column >= 0], row[column >= 0], len(rows)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings = Settings(), seed: int = 7) -> Model:
    """Non-negative positive-unlabelled training on feature lists, averaged over several classifiers."""
    if not positive or not unlabelled:
        return Model(-40.0, np.zeros(FEATURES, np.float32))
    hits, seen = (np.bincount(np.concatenate(x), minlength=FEATURES) for x in (positive, unlabelled))
    share = (seen + 1) / (len(unlabelled) + 1)
    excess = (hits / len(positive) - share) / np.sqrt(share / len(positive))
    used = np.flatnonzero((hits >= settings.min_texts) & (excess >= settings.min_excess))
    remap = np.full(FEATURES, -1, np.int64)
    remap[used] = np.arange(len(used))
    draw = np.random.default_rng(seed)
    bias, weights = [], np.zeros(FEATURES)
    for _ in range(settings.models):
        p = [positive[i] for i in draw.choice(len(positive), max(1, len(positive) * 4 // 5), replace=False)]
        u = [unlabelled[i] for i in draw.choice(len(unlabelled), max(1, len(unlabelled) * 4 // 5), replace=False)]
        w, b = _train_one(_csr(p, remap), _csr(u, remap), len(used), min(max(prior, 1e-3), 0.999), settings)
        weights[used] += w / settings.models
        bias.append(b)
    return Model(float(np.mean(bias)), weights.astype(np.float32))


def _train_one(p, u, size: int, prior: float, s: Settings):
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(size + 1), np.log(prior / (1 - prior))
    w[-1] = b
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def scores(x):
        column, row, n = x
        return np.bincount(row, weights=w[column], minlength=n) + w[-1]

    def gradient(x, slope):
        column, row, n = x
        return np.append(np.bincount(column, weights=slope[row], minlength=size), slope.sum()) / n

    for step in range(1, s.steps + 1):
        zp, zu = scores(p), scores(u)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = gradient(u, su) - prior * gradient(p, sp)
        # Below zero the second part is noise that was fitted: undo it instead.
        g = prior * gradient(p, sp - 1) + as_negative if negative >= 0 else -as_negative
        g[:-1] += s.decay * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - s.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], w[-1]


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to the columns ``keep`` (all by default).

    NULL and empty texts get the score of a text without any known word. Rows are scored
    one by one from their text alone, so repeated rows repeat; an empty table gives an
    empty result. Columns of the input with the new names are replaced. A very long text is scored whole;
    texts of equal words have equal scores, so there are no ties to break.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    # Fixed size: a weight per feature.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        live = m.weights != 0

        def work(batch):
            out = np.full(batch.num_rows, m.bias)
            for first, rows, data, starts in text_blocks(batch, text):
                lower = LOWER[data]
                begins, ends, row = word_bounds(lower, starts, ALNUM)
                word = (SpanHash(byte_values(lower))(begins, ends) % np.uint64(FEATURES)).astype(np.int64)
                known = live[word]
                key = np.unique(row[known] * FEATURES + word[known])
                out[first:first + rows] += np.bincount(key // FEATURES, weights=m.weights[key % FEATURES], minlength=rows)
            return [1 / (1 + np.exp(-np.clip(out, -40, 40)))]

        return work

    scored = map_text(docs.select(*dict.fromkeys([*keep, text])), start, "score double", keep)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
