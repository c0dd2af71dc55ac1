"""Language identification of spans and documents.

Each word's script range narrows the languages that can be meant; hashed byte n-grams score the
word for each of those; Viterbi over the words with a penalty for switching labels spans. A
document's language is the one with the most letters' bytes, its score that language's share.

The model is fitted on at most about ``fit_rows`` documents a language of no more than
``fit_bytes`` bytes each, chosen by a hash of doc_id (of rows that repeat a doc_id the least counts),
and on the ``most_languages`` most frequent values of lang. Tasks count the windows; the driver gets
the sums, at most FEATURES a language.

Defined cases: a null or letterless text is ``und`` with score 0 and no spans; without any
labelled document every text is ``und``; of equal shares the alphabetically first language wins;
a null doc_id is kept and never fitted on; a very long text is scored SCORE_BYTES at a time and
labelled as a whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are passed through by ``identify`` only if named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import best_states
from .common import lowered, need, slices, text_buffer, words_of
from .pretokens import LETTER, byte_classes, code_points

#: First code points of script ranges and the script that holds from there on. Fixed values.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_FROM = np.array([c for c, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_LATIN = SCRIPTS.index("latin")

#: Hash tables of 2-, 3- and 4-byte windows.
SIZES = (1 << 14, 1 << 16, 1 << 16)
OFFSETS = (0, SIZES[0], SIZES[0] + SIZES[1])
FEATURES = sum(SIZES)
PENALTY, SCALE, RARE_SCRIPT = 6.0, 0.5, 0.005
#: Bytes of text whose windows are scored at once, but for a longer word.
SCORE_BYTES = 1 << 18
#: Far below any sum of scores, as minus infinity would spoil the differences that the chains take.
EXCLUDED = -1e15


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashed windows at each byte, from the byte before it on; nothing beyond a word's ends shows."""
    text = lowered(data)
    space = np.isin(text, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    b0 = np.where(space, np.uint8(32), text).astype(np.uint32)

    def beside(x: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
        out = np.full_like(x, 32)
        if step < 0:
            out[1:] = x[:-1]
        else:
            out[:-1] = x[1:]
        out[edge] = 32
        return out

    n = len(text)
    heads, tails = offsets[:-1][offsets[:-1] < n], (offsets[1:] - 1)[offsets[1:] > 0]
    before, after = beside(b0, heads, -1), beside(b0, tails, 1)
    later = np.where(after == 32, 32, beside(after, tails, 1)).astype(np.uint32)
    two = before << 8 | b0
    three = two << 8 | after
    four = three << 8 | later
    spread = [two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B), four * np.uint32(0xC2B2AE35)]
    return [(h >> np.uint32(32 - size.bit_length() + 1)).astype(np.int64) + at for h, size, at in zip(spread, SIZES, OFFSETS)]


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    letters: np.ndarray  # bytes of letters in each word
    script: np.ndarray  # of the word's last letter outside the Latin range, else Latin


def words_with_scripts(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, rows = words_of(data, offsets)
    letter = byte_classes(data) == LETTER
    sums = np.concatenate([[0], np.cumsum(letter)])
    script = np.full(len(starts), _LATIN)
    at, points, _ = code_points(data)
    keep = letter[at]
    at, kind = at[keep], _SCRIPT[np.searchsorted(_FROM, points[keep], side="right") - 1]
    at, kind = at[kind != _LATIN], kind[kind != _LATIN]
    script[np.searchsorted(starts, at, side="right") - 1] = kind
    return Words(starts, ends, rows, sums[ends] - sums[starts], script)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages
    allowed: np.ndarray  # scripts x languages
    penalty: float = PENALTY

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words, and the language number of each."""
        words = words_with_scripts(data, offsets)
        emissions = np.empty((len(words.starts), len(self.languages)))
        at = 0
        while at < len(words.starts):
            # Words from one place on; windows don't look beyond a word's ends.
            first = words.starts[at]
            to = max(at + 1, int(np.searchsorted(words.ends, first + SCORE_BYTES, side="right")))
            part = data[first : words.ends[to - 1]]
            edges = np.unique(np.concatenate([[0, len(part)], np.clip(offsets - first, 0, len(part))]))
            two, three, four = grams(part, edges)
            sums = np.zeros((len(part) + 1, len(self.languages)))
            np.cumsum(self.weights[two] + self.weights[three] + self.weights[four], axis=0, dtype=np.float64, out=sums[1:])
            emissions[at:to] = sums[words.ends[at:to] - first] - sums[words.starts[at:to] - first]
            at = to
        emissions *= (words.letters > 0)[:, None]
        # A language that isn't written in a word's script is no candidate.
        emissions[~self.allowed[words.script] & (words.letters > 0)[:, None]] = EXCLUDED
        counts = np.bincount(words.rows, minlength=len(offsets) - 1)
        held = counts > 0
        return words, best_states(emissions, counts[held], self.penalty) if held.any() else np.zeros(0, np.int64)


def fit(docs: DataFrame, fit_rows: int = 400, fit_bytes: int = 1 << 16, most_languages: int = 256) -> LanguageModel:
    """A model of the labelled documents that aren't held out."""
    need(docs, "doc_id", "text", "lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.octet_length("text") <= fit_bytes))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not sizes:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    # A chance by language keeps the sample's expected size at fit_rows for each.
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(fit_rows / n))))
    numbers = F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))))
    # One row an id: a repeated id, even a third of all rows, doesn't make the sample grow.
    one = F.min(F.struct("text", "lang")).alias("one")
    sample = rows.where(chance < F.try_element_at(rates, F.col("lang"))).groupBy("doc_id").agg(one).select("one.text", F.element_at(numbers, F.col("one.lang")).alias("number"))

    def run(batches):
        """number, feature, times: windows, and words by script behind them."""
        for batch in batches:
            for number in sorted(set(batch.column("number").to_pylist())):
                own = batch.filter(pa.compute.equal(batch.column("number"), number))
                counts = np.zeros(FEATURES + len(SCRIPTS), np.int64)
                for part in slices(own, "text"):
                    data, offsets = text_buffer(part.column("text"))
                    words = words_with_scripts(data, offsets)
                    inside = np.repeat(words.letters > 0, words.ends - words.starts)
                    places = np.flatnonzero(~np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8)))[inside]
                    for found in grams(data, offsets):
                        counts[:FEATURES] += np.bincount(found[places], minlength=FEATURES)
                    counts[FEATURES:] += np.bincount(words.script[words.letters > 0], minlength=len(SCRIPTS))
                held = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number, np.int32)), pa.array(held.astype(np.int32)), pa.array(counts[held])], ["number", "feature", "times"])

    sums = sample.mapInArrow(run, "number int, feature int, times long").groupBy("number", "feature").agg(F.sum("times").alias("times")).toArrow()
    both = np.zeros((FEATURES + len(SCRIPTS), len(languages)))
    both[sums.column("feature").to_numpy(), sums.column("number").to_numpy()] = sums.column("times").to_numpy()
    counts, scripts = both[:FEATURES], both[FEATURES:]
    weights = np.zeros_like(counts)
    for at, size in zip(OFFSETS, SIZES):
        own = counts[at : at + size] + 0.5
        weights[at : at + size] = np.log(own / own.sum(0))
    weights = (weights - weights.mean(1, keepdims=True)) * SCALE
    allowed = scripts >= RARE_SCRIPT * np.maximum(1, scripts.sum(0))
    allowed |= ~allowed.any(1)[:, None]
    return LanguageModel(languages, weights.astype(np.float32), allowed)


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def spans_of(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, words: Words, labels: np.ndarray) -> list[list[dict]]:
    """Of each row, the maximal runs of words with one language, in characters."""
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    if len(labels):
        new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.rows[1:] != words.rows[:-1])]))
        last = np.append(new[1:], len(labels)) - 1
        for a, b in zip(new.tolist(), last.tolist()):
            row = int(words.rows[a])
            base = characters[offsets[row]]
            out[row].append({"begin": int(characters[words.starts[a]] - base), "end": int(characters[words.ends[b]] - base), "lang": model.languages[labels[a]]})
    return out


def identify(docs: DataFrame, model: LanguageModel, spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, lang_pred, score and spans (array of begin, end, lang)."""
    need(docs, "doc_id", "text", *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES x languages
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    names = [c for c in rows.columns if c not in ("lang_pred", "score", "spans")]
    if len(names) < len(rows.columns):
        raise ValueError("keep: names of the results can't be kept")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", SPANS)] if spans else [])])

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                n, many = len(offsets) - 1, max(1, len(model.languages))
                if model.languages:
                    words, labels = model.label(data, offsets)
                else:
                    words, labels = words_with_scripts(data, offsets), np.zeros(0, np.int64)
                    words.letters[:] = 0
                shares = np.bincount(words.rows[: len(labels)] * many + labels, words.letters[: len(labels)], n * many).reshape(n, many)
                total = shares.sum(1)
                best = shares.argmax(1)
                pred = [model.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())]
                score = shares[np.arange(n), best] / np.maximum(total, 1)
                more = [pa.array([s if t else [] for s, t in zip(spans_of(model, data, offsets, words, labels), total)], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if spans else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), *more], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
