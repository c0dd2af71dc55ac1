"""Identity by hashes: families of strings that fool polynomial hashes, clashes on purpose, long texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracequarry.llm import common, ngram_join, word_codec
from tracequarry.llm.bpe_fst import vocabulary

RANKS, LIBRARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def alternating(size: int, a: str, b: str) -> str:
    """The Thue-Morse word, and with a and b exchanged its complement: equal modulo 2**64 for any base."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(size))


FOES = [alternating(n, a, b) for n in (1024, 4096) for a, b in ("ab", "ba")]


def buffer(texts):
    return common.text_buffer(common.pa.array(texts))


def texts(seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("ab cd\n\t  é日　 'sre12!😀\u0085  ", k=r.randint(0, 300))) for _ in range(200)] + [*FOES, "", "x <|endoftext|><|endoftext|> y"]


def of_rows(ids, counts):
    ends = np.cumsum(counts)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]


@pytest.mark.parametrize("chunk", [1 << 20, 61])
def test_ids_are_the_libraries(monkeypatch, chunk):
    monkeypatch.setattr(word_codec, "CHUNK_BYTES", chunk)
    lib = Tokenizer.from_file(LIBRARY)
    codec = word_codec.library_codec(LIBRARY, encode_special_tokens=False)
    assert of_rows(*codec.encode(*buffer(texts(1)))) == [lib.encode(t, add_special_tokens=False).ids for t in texts(1)]
    codec = word_codec.PieceCodec(vocabulary(RANKS).transducer.encode_many)
    whole = [vocabulary(RANKS).codec.encode(*buffer([t]))[0].tolist() for t in texts(2)]
    assert of_rows(*codec.encode(*buffer(texts(2)))) == whole


def test_clashing_pieces_keep_their_own_ids(monkeypatch):
    right = of_rows(*word_codec.PieceCodec(vocabulary(RANKS).transducer.encode_many).encode(*buffer(texts(3))))
    real = common.span_hashes
    monkeypatch.setattr(word_codec, "span_hashes", lambda *a: real(*a) % np.uint64(40))
    codec = word_codec.PieceCodec(vocabulary(RANKS).transducer.encode_many)
    assert of_rows(*codec.encode(*buffer(texts(3)))) == right and codec.clashing


def test_hashes_tell_spans_apart():
    r = random.Random(5)
    words = sorted({"".join(r.choices("ab", k=r.randint(1, 24))) for _ in range(4000)} | set(FOES) | {"a" * n for n in range(1, 600)})
    data, offsets = buffer(words)
    hashes = common.span_hashes(data, offsets[:-1], offsets[1:])
    assert len(set(hashes.tolist())) == len(words)
    twice, at = buffer(words + words)
    assert common.span_hashes(twice, at[:-1], at[1:]).tolist() == hashes.tolist() * 2
    sizes = np.diff(offsets)
    assert common.equal_spans(data, offsets[:-1], twice, at[len(words) : -1], sizes).all()
    other = np.array([w[:-1] + "c" for w in words])
    assert not common.equal_spans(data, offsets[:-1], buffer(other.tolist())[0], offsets[:-1], sizes).any()


def test_unlike_long_words_are_not_linked(spark):
    found = ngram_join.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(FOES)], "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(i, 1, i) for i in range(4)]


def test_clashing_sets_stay_apart(spark, monkeypatch):
    from tests.llm.test_searches import brute_classes, near_rows

    rows = near_rows(8, 30, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = ngram_join.entities

    def few(r, h, many, clashing):
        sizes, digest, second = real(r, h, many, np.zeros(0, np.int64))
        digest = digest % 64
        return sizes, np.where(np.isin(digest, clashing), second, digest), second

    monkeypatch.setattr(ngram_join, "entities", few)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str) == sorted(brute_classes(rows), key=str)
