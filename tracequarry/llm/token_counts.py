"""Token counts by section: whole documents are encoded once, their tokens joined to sections by character spans.

Each token covers the characters that its bytes belong to. A token counts for a section if its
anchor character lies in the section's span [begin, end). The anchor settles tokens that cross a
boundary: ``first`` (default), ``last`` or ``middle`` character of the token.

Defined cases: a null or empty text has no tokens, and one empty section if sections are lines;
spans may overlap or leave gaps (a token then counts for each, or none); a null list of sections
gives no rows, a null bound counts as 0 (begin) or the text's end (end); a null doc_id is kept;
repeated rows give repeated results; a very long text is encoded in parts; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, slices, text_buffer
from .word_codec import library_codec, token_lengths

ANCHORS = ("first", "last", "middle")


def token_anchors(data: np.ndarray, ids: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(character, counted over all rows, of each token's anchor; number of characters up to each byte)."""
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    end = np.cumsum(lengths[ids])
    first = characters[end - lengths[ids] + 1] - 1 if len(ids) else np.zeros(0, np.int64)
    last = characters[end] - 1
    return {"first": first, "last": last, "middle": (first + last) // 2}[rule], characters


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) of each line, its line feed included; an empty row has one empty line."""
    feeds = np.flatnonzero(data == 0x0A) + 1
    ends = np.unique(np.concatenate([feeds, offsets[1:][np.diff(offsets) > 0]])).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    rows = np.searchsorted(offsets, starts, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    rows, starts, ends = np.concatenate([rows, empty]), np.concatenate([starts, offsets[empty]]), np.concatenate([ends, offsets[empty]])
    order = np.argsort(rows, kind="stable")
    return rows[order], starts[order], ends[order]


def count_tokens(docs: DataFrame, tokenizer_path: str, rule: str = "first", sections: str | None = None, encode_special_tokens: bool = True) -> DataFrame:
    """doc_id, section (number in its document), begin, end (characters), n_tokens, doc_tokens.

    ``sections``: a column of array<struct<begin int, end int>>; without it the lines are the sections.
    ``encode_special_tokens``: as in ``library_codec``.
    """
    need(docs, "doc_id", "text", *([sections] if sections else []))
    if rule not in ANCHORS:
        raise ValueError(f"rule: one of {', '.join(ANCHORS)}")

    def run(batches):
        codec, lengths = library_codec(tokenizer_path, encode_special_tokens), token_lengths(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                ids, counts = codec.encode(data, offsets)
                anchors, characters = token_anchors(data, ids, lengths, rule)
                base = characters[offsets]
                if sections:
                    lists = part.column("sections").to_pylist()
                    spans = [(r, s) for r, x in enumerate(lists) for s in x or [] if s is not None]
                    rows = np.array([r for r, _ in spans], np.int64)
                    size = np.diff(base)[rows]
                    begin = np.clip(np.array([s["begin"] or 0 for _, s in spans], np.int64), 0, size)
                    end = np.array([-1 if s["end"] is None else s["end"] for _, s in spans], np.int64)
                    end = np.maximum(begin, np.where(end < 0, size, np.minimum(end, size)))
                else:
                    rows, begin, end = line_spans(data, offsets)
                    begin, end = characters[begin] - base[rows], characters[end] - base[rows]
                found = np.searchsorted(anchors, base[rows] + end) - np.searchsorted(anchors, base[rows] + begin)
                first = np.searchsorted(rows, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), *(pa.array(np.asarray(x, np.int64)) for x in (np.arange(len(rows)) - first, begin, end, found, counts[rows]))],
                    ["doc_id", "section", "begin", "end", "n_tokens", "doc_tokens"],
                )

    columns = ["CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"] + ([f"`{sections}` AS sections"] if sections else [])
    return docs.selectExpr(*columns).mapInArrow(run, "doc_id long, section long, begin long, end long, n_tokens long, doc_tokens long")
