"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are the chain's items; their features are the hashed lower-case word without punctuation
at its ends, and that word's first four to eight bytes. Token labels come from labelled
documents: in documents labelled toxic, words with a feature that is much more frequent in toxic
than in clean documents are toxic tokens; of near copies one counts. Weights and transitions are
fitted by gradient ascent on the chain's likelihood. The forward-backward marginals give the
offending spans; with the number of words they give the document's score through a logistic
regression fitted to the same labels.

The model is fitted on at most about ``fit_rows`` toxic and four times as many clean documents of
no more than ``fit_bytes`` bytes each, chosen by a hash of doc_id (of rows that repeat a doc_id the
least text counts); the chain's weights on at most ``CHAIN_ROWS`` of each label.

Defined cases: a null or empty text has the score of a text without toxic words and no spans;
without documents of both labels every score is the smoothed share of toxic ones; null labels and
null ids aren't fitted on; a very long text takes memory in proportion to its words, about 150 bytes
each; repeated rows give repeated results; an empty table gives an empty
result; other columns are passed through by ``score`` only if named in ``keep``.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import SumProduct, marginals, messages
from .common import lowered, need, slices, span_hashes, text_buffer, words_of
from .lang_id import held_out

BUCKETS, PREFIXES = 1 << 18, (4, 5, 6, 7, 8)
#: A feature marks toxic tokens at this log ratio of document shares, and in this share of toxic documents.
RATIO, SUPPORT, CLEAN_TIMES = 2.5, 0.015, 4
STEPS, RATE, DECAY, CHAIN_ROWS = 15, 1.0, 1e-5, 500
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    features: np.ndarray  # tokens x (1 + prefixes)
    counts: np.ndarray  # tokens of each row


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, rows = words_of(data, offsets)
    for _ in range(4):
        starts = starts + ((ends - starts > 1) & _PUNCTUATION[data[starts]])
        ends = ends - ((ends - starts > 1) & _PUNCTUATION[data[ends - 1]])
    text = lowered(data)
    hashes = [span_hashes(text, starts, ends)]
    hashes += [span_hashes(text, starts, np.minimum(starts + k, ends)) + np.uint64(k) for k in PREFIXES]
    features = np.stack([(h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int32) for h in hashes], 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    return Tokens(starts, ends, rows, features, np.bincount(rows, minlength=len(offsets) - 1))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by feature bucket, for toxic against clean
    bias: float
    steps: np.ndarray  # transition weights
    curve: np.ndarray  # logistic regression on ``summary``
    constant: float | None = None

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """The probability of each token to be toxic."""
        held = tokens.counts[tokens.counts > 0]
        if not len(held):
            return np.zeros(0)
        return marginals(self._emissions(tokens), held, self.steps)[:, 1]

    def _emissions(self, tokens: Tokens) -> np.ndarray:
        odds = np.clip(self.bias + self.weights[tokens.features].sum(1), -30, 30)
        return np.stack([np.ones(len(odds)), np.exp(odds)], 1)

    def document_scores(self, tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(tokens.counts), self.constant)
        return logistic(summary(tokens, toxic) @ self.curve)


def summary(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Of each row: 1, log of the toxic tokens expected (doubtful ones count little), log of its tokens."""
    expected = np.bincount(tokens.rows, toxic**4, len(tokens.counts))
    return np.stack([np.ones(len(expected)), np.log(expected + 0.05), np.log(tokens.counts + 10.0)], 1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def label_tokens(tokens: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels (see the module's text)."""
    shares = []
    for label in (1, 0):
        own = toxic[tokens.rows] == label
        count = np.zeros(BUCKETS, np.int64)
        for k in range(tokens.features.shape[1]):  # a feature's column is in its hash, so columns don't meet
            count += np.bincount(np.unique(tokens.features[own, k] + tokens.rows[own] * BUCKETS) % BUCKETS, minlength=BUCKETS)
        shares.append(count)
    many = [max(1, int((toxic == label).sum())) for label in (1, 0)]
    ratio = np.log((shares[0] + 0.5) / (many[0] + 1)) - np.log((shares[1] + 0.5) / (many[1] + 1))
    marks = (ratio >= RATIO) & (shares[0] >= max(3, SUPPORT * many[0]))
    return marks[tokens.features].any(1) & (toxic[tokens.rows] == 1)


def some_rows(tokens: Tokens, kept: np.ndarray) -> Tokens:
    """The tokens of the rows that are kept."""
    own = kept[tokens.rows]
    rows = (np.cumsum(kept) - 1)[tokens.rows[own]]
    if tokens.starts is tokens.rows:  # places aren't kept
        return Tokens(rows, rows, rows, tokens.features[own], tokens.counts[kept])
    return Tokens(tokens.starts[own], tokens.ends[own], rows, tokens.features[own], tokens.counts[kept])


def one_of_copies(tokens: Tokens) -> np.ndarray:
    """Whether a row is the first with its smallest hash of three words; rows without words are kept."""
    h = tokens.features[:, 0].astype(np.uint64)
    follow = np.concatenate([h, np.zeros(2, np.uint64)])
    three = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (follow[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (follow[2:] * np.uint64(0x165667B19E3779F9))
    three = three * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(8)
    filled = np.flatnonzero(tokens.counts > 0)
    first = (np.cumsum(tokens.counts) - tokens.counts)[filled]
    kept = np.ones(len(tokens.counts), bool)
    if len(filled):
        _, example = np.unique(np.minimum.reduceat(three, first), return_index=True)
        kept[filled] = False
        kept[filled[example]] = True
    return kept


def train(tokens: Tokens, toxic: np.ndarray, odds: float) -> ToxicityModel:
    """``tokens``: one of copies. odds: how many times as frequent clean documents are as in the sample, against toxic ones."""
    everything, every_label = tokens, toxic
    all_labels = label_tokens(tokens, toxic)
    chosen = np.zeros(len(toxic), bool)
    for label in (0, 1):
        chosen[np.flatnonzero(toxic == label)[:CHAIN_ROWS]] = True
    labels = all_labels[chosen[tokens.rows]]
    tokens = some_rows(tokens, chosen)
    held = tokens.counts[tokens.counts > 0]
    model = ToxicityModel(np.zeros(BUCKETS), float(np.log((labels.sum() + 1) / (len(labels) + 2))), np.array([[0.5, 0.5], [0.5, 0.5]]), np.zeros(3))
    log_steps = np.log(model.steps)
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(held) - held] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][inner[1:]].astype(int), labels[1:][inner[1:]].astype(int)), 1)
    squares, bias_square, step_squares = np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(STEPS):
        emissions = model._emissions(tokens)
        forward = messages(emissions, held, SumProduct(model.steps))
        backward = messages(emissions[::-1], held[::-1], SumProduct(model.steps.T))[::-1]
        single = forward * backward / emissions
        p = single[:, 1] / single.sum(1)
        pairs = forward[:-1][inner[1:]][:, :, None] * model.steps * backward[1:][inner[1:]][:, None, :]
        expected = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)
        error = labels - p
        slope = sum(np.bincount(tokens.features[:, k], error, BUCKETS) for k in range(tokens.features.shape[1])) - DECAY * len(labels) * model.weights / STEPS
        squares += slope**2
        model.weights = model.weights + RATE * slope / np.sqrt(squares)
        bias_square += error.sum() ** 2
        model.bias += RATE * error.sum() / np.sqrt(bias_square)
        step_squares += (seen - expected) ** 2
        log_steps = log_steps + 0.5 * RATE * (seen - expected) / np.sqrt(step_squares)
        model.steps = np.exp(log_steps - log_steps.max())
    parts = []
    for k in range(0, len(every_label), 300):
        part = some_rows(everything, (np.arange(len(every_label)) >= k) & (np.arange(len(every_label)) < k + 300))
        parts.append(summary(part, model.marginals(part)))
    inputs = np.concatenate(parts)
    model.curve = fit_curve(inputs, every_label.astype(float), np.where(every_label == 1, 1.0, odds))
    return model


def fit_curve(inputs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    beta = np.zeros(inputs.shape[1])
    for _ in range(60):
        p = logistic(inputs @ beta)
        slope = inputs.T @ (weight * (y - p)) - 0.1 * beta
        bend = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 1000, fit_bytes: int = 1 << 16) -> ToxicityModel:
    """A model of the labelled documents that aren't held out."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    few, many = sizes.get(1, 0), sizes.get(0, 0)
    empty = ToxicityModel(np.zeros(1), 0.0, np.eye(2), np.zeros(3), (few + 0.5) / (few + many + 1))
    if not few or not many:
        return empty
    chance = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(chance < F.when(F.col("toxic") == 1, fit_rows / few).otherwise(CLEAN_TIMES * fit_rows / many)).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= fit_bytes)
    # The sample has about (1 + CLEAN_TIMES) * fit_rows rows, whatever the tables' sizes; one task fits the model.
    # One row an id and label: a repeated id, even a third of all rows, doesn't make the sample grow.
    once = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = once.repartition(1).sortWithinPartitions("doc_id", "text", "toxic").select("text", "toxic")

    def run(batches):
        features, rows, counts, toxic, first = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = tokens_of(*text_buffer(part.column("text")))
                features.append(tokens.features)
                rows.append(tokens.rows + first)
                counts.append(tokens.counts)
                toxic.append(part.column("toxic").to_numpy().astype(np.int64))
                first += part.num_rows
        labels = np.concatenate(toxic) if toxic else np.zeros(0, np.int64)
        if (labels == 1).any() and (labels == 0).any():
            # Only what the fit reads, and no second copy while it runs.
            of = np.concatenate(rows)
            tokens = Tokens(of, of, of, np.concatenate(features), np.concatenate(counts))
            features.clear(), rows.clear()
            odds = many / few * (labels == 1).sum() / (labels == 0).sum()
            kept = one_of_copies(tokens)
            tokens, labels = some_rows(tokens, kept), labels[kept]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(tokens, labels, float(odds)))], pa.binary())], ["model"])

    found = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else empty


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def spans_of(data: np.ndarray, offsets: np.ndarray, tokens: Tokens, toxic: np.ndarray) -> list[list[dict]]:
    """Of each row, the runs of tokens with a marginal of at least a half, in characters."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    bad = np.flatnonzero(toxic >= 0.5)
    if len(bad):
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        new = np.concatenate([[True], (np.diff(bad) > 1) | (np.diff(tokens.rows[bad]) > 0)])
        first = bad[new]
        last = bad[np.append(np.flatnonzero(new)[1:], len(bad)) - 1]
        for a, b in zip(first.tolist(), last.tolist()):
            row = int(tokens.rows[a])
            base = characters[offsets[row]]
            out[row].append({"begin": int(characters[tokens.starts[a]] - base), "end": int(characters[tokens.ends[b]] - base), "probability": float(toxic[a : b + 1].max())})
    return out


def score(docs: DataFrame, model: ToxicityModel, spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, score and toxic_spans (array of begin, end, probability)."""
    need(docs, "doc_id", "text", *keep)
    if {"score", "toxic_spans"} & set(keep):
        raise ValueError("keep: names of the results can't be kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS weights
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), *([T.StructField("toxic_spans", SPANS)] if spans else [])])

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                tokens = tokens_of(data, offsets)
                toxic = model.marginals(tokens) if model.constant is None else np.zeros(len(tokens.rows))
                more = [pa.array(spans_of(data, offsets, tokens, toxic), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))] if spans else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.document_scores(tokens, toxic)), *more], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
