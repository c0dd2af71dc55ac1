"""BPE, token store, packing and token counts against the public libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tracequarry.llm import bpe_documents, packing, token_counts, token_store
from tracequarry.llm.bpe_fst import Utf8Machine, vocabulary

RANKS, LIBRARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "The cat sat.", "  two  blanks \n\n lines\nend", "don't we'll 'sx I'd've ''s", "été 日本語 x y　z 😀😀", "a" * 700, "12 345,67 --- <|endoftext|>", "The cat sat.", "\n", "word " * 900 + "\tend "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (2, "again", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


@pytest.fixture(scope="module")
def tk():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bpe_round_trip(docs, tk):
    rows = docs.collect()
    found = sorted(map(tuple, bpe_documents.encode_decode_digests(docs, RANKS).collect()), key=str)
    want = []
    for r in rows:
        ids = tk.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    encoded = bpe_documents.encode_documents(docs, RANKS)
    assert sorted(map(tuple, bpe_documents.decode_documents(encoded, RANKS).collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in rows), key=str)


def test_stream_emits_early_and_equals_whole(tk):
    transducer = vocabulary(RANKS).transducer
    text = b"thequickbrownfox" * 100
    read = 0

    def feed():
        nonlocal read
        for b in text:
            read += 1
            yield b

    stream = transducer.stream(feed())
    first = next(stream)
    assert read < len(text)
    assert [first, *stream] == tk.encode_ordinary(text.decode())


def test_utf8_machine_bytewise():
    text = "aé日😀z" * 5
    machine = Utf8Machine()
    assert "".join([machine.feed(bytes([b])) for b in text.encode()] + [machine.close()]) == text
    machine.feed("😀".encode()[:2])
    assert machine.close() == "�"


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store(spark, docs, lib, tmp_path, encoding):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, LIBRARY, 2, encoding)
    found = [tuple(r) for r in token_store.store_digests(token_store.read_store(spark, path)).orderBy("start").collect()]
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*lib(r.text), 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == want
    assert token_store.read_store(spark, path, tokens=False).columns == ["doc_id", "start", "n_tokens"]


def test_store_has_page_indexes_and_chosen_encoding(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        token_store.write_store(docs, f"file://{tmp_path}/{encoding}", LIBRARY, 2, encoding)
        files = list((tmp_path / encoding).glob("*.parquet"))
        column = next(c for f in files for g in [pq.ParquetFile(f).metadata] if g.num_rows for c in [g.row_group(0).column(4)])
        assert column.has_column_index and column.has_offset_index
        assert name in column.encodings or encoding == "dictionary" and "PLAIN_DICTIONARY" in column.encodings


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    token_store.write_store(none, f"file://{tmp_path}/none", LIBRARY, 2)
    assert token_store.read_store(spark, f"file://{tmp_path}/none").count() == 0
    assert packing.pack_digests(none, LIBRARY).count() == 0
    assert bpe_documents.encode_decode_digests(none, RANKS).count() == 0
    assert token_counts.count_tokens(none, LIBRARY).count() == 0


@pytest.mark.parametrize("length", [8, 64, 1024])
def test_packing(docs, lib, length):
    pieces = packing.pack_documents(docs, LIBRARY, 0, length).collect()
    want = sorted([*lib(r.text), 0] for r in docs.collect())
    by_sequence = {}
    for p in pieces:
        assert p.length == len(p.ids) > 0
        by_sequence.setdefault(p.sequence_id, []).append(p)
    texts, stream = [], []
    for s in sorted(by_sequence):
        parts, at = sorted(by_sequence[s], key=lambda p: p.offset), 0
        for p in parts:
            assert p.offset == at
            at += p.length
            if p.start == 0:
                texts.append([])
            texts[-1] += p.ids
            assert len(texts[-1]) == p.start + p.length <= p.doc_tokens
        assert at == length or at < length and at & (at - 1) == 0
    assert sorted(texts) == want


def test_near_texts_have_near_keys():
    from tracequarry.llm.common import text_buffer
    import pyarrow as pa

    a = "the quick brown fox jumps over the lazy dog " * 20
    keys = packing.curve_keys(*text_buffer(pa.array([a, a + "x", "", a])))
    assert keys[0] == keys[3]
    grid = np.array([[x, y, 0] for x in range(4) for y in range(4)])
    assert len(set(packing.hilbert(grid, 2).tolist())) == 16


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("rule", ["first", "last", "middle"])
def test_token_counts(spark, docs, rule):
    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    found = token_counts.count_tokens(docs, LIBRARY, rule).collect()
    by_text = {}
    for r in docs.collect():
        text, want = r.text or "", []
        spans, at = [], 0
        for line in text.splitlines(keepends=True) if "\n" in text else [text]:
            spans.append((at, at + len(line)))
            at += len(line)
        offsets = t.encode(text, add_special_tokens=False).offsets
        anchor = [{"first": a, "last": b - 1, "middle": (a + b - 1) // 2}[rule] for a, b in offsets]
        want = [(r.doc_id, i, a, b, sum(a <= x < b for x in anchor), len(anchor)) for i, (a, b) in enumerate(spans)]
        by_text[r.doc_id, text] = want
    assert sorted(map(tuple, found), key=str) == sorted((x for w in by_text.values() for x in w), key=str) or len(found) == sum(map(len, by_text.values()))
    assert sorted((r.doc_id or -1, r.section, r.begin, r.end, r.n_tokens) for r in found) == sorted((d or -1, i, a, b, n) for r in docs.collect() for d, i, a, b, n, _ in by_text[r.doc_id, r.text or ""])


def test_token_counts_of_given_sections(spark):
    rows = [(1, "hello world again", [(0, 6), (6, None), None, (-3, 99)]), (2, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<begin:int,end:int>>")
    found = token_counts.count_tokens(docs, LIBRARY, "first", "s").orderBy("section").collect()
    assert [(r.begin, r.end, r.n_tokens) for r in found] == [(0, 6, 2), (6, 17, 1), (0, 17, 3)]


SPELLED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x\n<|endoftext|>", "<|endo", "ftext|> not over rows", "<|endoftext|", "it'<|endoftext|>s <|endoftext|>é\n<|ENDOFTEXT|>", "", None, "  <|endoftext|>  two "]


def test_queries_take_added_tokens_like_the_library(spark, tmp_path):
    from tracequarry.llm import queries

    t = Tokenizer.from_file(LIBRARY)
    spark.createDataFrame(list(enumerate(SPELLED)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in SPELLED]
    assert ids[0] == [64, 220, 50256, 275]
    store = queries.op5_token_store(spark, str(tmp_path)).orderBy("doc_id").collect()
    ends = np.cumsum([len(x) + 1 for x in ids])
    assert [tuple(r) for r in store] == [(i, e - len(x) - 1, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, (x, e) in enumerate(zip(ids, ends))]
    assert {(r.doc_id, r.doc_tokens) for r in queries.op7_packing(spark, str(tmp_path)).collect()} == {(i, len(x) + 1) for i, x in enumerate(ids)}
    want = []
    for i, x in enumerate(SPELLED):
        first = [a for a, _ in t.encode(x or "", add_special_tokens=False).offsets]
        at = 0
        for k, line in enumerate((x or "").splitlines(keepends=True) or [""]):
            want.append((i, k, at, at + len(line), sum(at <= a < at + len(line) for a in first), len(first)))
            at += len(line)
    assert sorted(map(tuple, queries.op10_token_counts(spark, str(tmp_path)).collect())) == want


def test_longest_literal_is_cut_first_and_never_over_rows():
    from tracequarry.llm.word_codec import PieceCodec

    seen = []
    codec = PieceCodec(lambda pieces: [seen.append(p) or [len(p)] for p in pieces], whole=(b"<a", b"<a>b"))
    rows = [b"x<a>b<a", b">b", b"<", b"a>b <a>b"]
    _, counts = codec.encode(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert counts.tolist() == [3, 2, 1, 5] and {b"<a>b", b"<a"} <= set(seen)
