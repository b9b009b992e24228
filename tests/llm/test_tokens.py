"""Token ids, packing and the coded files: exact round trips."""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftwork.llm import cut_packing, huffman_ids
from weftwork.llm.token_cache import Encoder, default_path

PATH = default_path()
WHOLE = Tokenizer.from_file(PATH)
CACHED = Encoder(PATH)
ODD = ["", " ", "it's don't I'LL x'S ''s", "á b́ ́x", "İstanbul ΑΣ ς", "tab\tx\xa0y z \x1c q\r\nw\x85v", "日本語 ☃️ x² ½ ªº", "a.b,c...d!?--e__f", "9 12 3.5", "<|end", "x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|>b <|STARTOFTEXT|> <|endoftext|>", "ß ẞ Ǆ", "soft\xadhyphen zero​width"]


@pytest.mark.parametrize("text", ODD)
def test_cached_ids_are_the_tokenizers(text):
    assert np.frombuffer(CACHED.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_cached_ids_of_any_text(text):
    assert np.frombuffer(CACHED.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|", "|>", "a", "É", " ", "\n", "endoftext", "<|EndOfText|>"]), max_size=8))
def test_cached_ids_with_added_tokens(parts):
    text = "".join(parts)
    assert np.frombuffer(CACHED.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_codes_of_large_alphabets():
    r = np.random.default_rng(6)
    counts = r.integers(1, 50, 70_000)
    lengths = huffman_ids.code_lengths(counts)
    assert lengths.max() > 16 and sum(2.0 ** -lengths.astype(float)) == pytest.approx(1)
    code, ids = huffman_ids.Code(lengths), r.integers(0, 70_000, 1001).astype("<u4")
    data, runs = code.encode(ids)
    assert np.array_equal(code.decode(data, runs, len(ids)), ids)


def test_least_doc_id_and_none(spark):
    rows = [(-(2**63), "a b"), (None, "c"), (None, "d e"), (5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = huffman_ids.digests(*huffman_ids.write(docs, PATH, 1)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, -(2**63)), (False, 5), (True, 0), (True, 0)]
    few = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string")
    assert cut_packing.pieces(few, PATH, 2, 16).count() == 2 and huffman_ids.digests(*huffman_ids.write(few, PATH, 1)).count() == 2


def test_other_tokenizers_are_not_split():
    assert not Encoder(public_tokenizers.path("byte_bpe_50k.json")).by_piece


def documents(spark):
    r = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma,", "delta.", "éclair", "Über", "x1"]
    texts = [" ".join(words[k] for k in r.integers(0, 7, r.integers(0, 400))) for _ in range(60)]
    rows = [(int(i), t, "e") for i, t in zip(r.permutation(60), texts, strict=True)] + [(70, None, "e"), (71, "", "e"), (72, "long " * 9000, "e"), (80, "again and again", "e"), (80, "again and again", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5), rows


def ids(text, end):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def test_packing_covers_every_id_once(spark):
    docs, rows = documents(spark)
    got = cut_packing.pieces(docs, PATH, 2, 512).collect()
    whole = sorted((i, tuple(ids(t, 2))) for i, t, _ in rows)
    own = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)


    by_doc = {i: x for i, x in whole}
    assert all(crc(by_doc[i][s : s + n]) == c and len(by_doc[i]) == m for i, s, n, c, m in own)
    assert sum(x[2] for x in own) == sum(len(x) for _, x in whole)
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    sizes = []
    for k, (number, part) in enumerate(groupby(got, key=lambda r: r.sequence_id)):
        at = 0
        assert number == k
        for r in part:
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(x == 512 for x in sizes[:-1])


def test_sequences_are_padded(spark):
    docs, rows = documents(spark)
    got = cut_packing.sequences(docs, PATH, 2, 512, pad_id=9).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 2048 for r in got)
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    n = sum(r.n_tokens for r in got)
    assert n == sum(len(ids(t, 2)) for _, t, _ in rows) and (flat[n:] == 9).all() and (flat[:n] == 2).sum() == len(rows)


def test_files_round_trip(spark):
    docs, rows = documents(spark)
    blocks, code = huffman_ids.write(docs, PATH, 1, block_tokens=700)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in huffman_ids.digests(blocks, code).collect())
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        x = ids(t, 1)
        want.append((i, at, len(x), crc(x)))
        at += len(x)
    assert got == sorted(want)
    back = sorted((r.doc_id, r.ids) for r in huffman_ids.read(spark, blocks, code).collect())
    assert back == sorted((i, ids(t, 1)) for i, t, _ in rows)
    assert blocks.count() > 20


def test_empty_tables(spark):
    docs, _ = documents(spark)
    assert cut_packing.pieces(docs.limit(0), PATH, 2).count() == 0
    assert huffman_ids.digests(*huffman_ids.write(docs.limit(0), PATH, 1)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert huffman_ids.digests(*huffman_ids.write(nulls, PATH, 1)).count() == 2
    assert cut_packing.pieces(nulls, PATH, 2).count() == 2


def shortest(counts, limit):
    """Total bits of the best length-limited code, by trying all Kraft-feasible lengths."""
    from functools import cache

    counts = sorted(counts, reverse=True)

    @cache
    def down(k, room, least):
        if k == len(counts):
            return 0
        return min((counts[k] * n + down(k + 1, room - (1 << (limit - n)), n) for n in range(least, limit + 1) if room >= 1 << (limit - n)), default=float("inf"))

    return down(0, 1 << limit, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=9), st.integers(4, 6))
def test_code_lengths_are_the_best_within_the_limit(counts, limit):
    lengths = huffman_ids.code_lengths(np.asarray(counts), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths) <= 1
    assert sum(int(n) * c for n, c in zip(lengths, counts, strict=True)) == shortest(counts, limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=500))
def test_any_ids_decode(values):
    x = np.asarray(values, "<u4")
    code = huffman_ids.Code(huffman_ids.code_lengths(np.bincount(x)))
    data, runs = code.encode(x)
    assert code.decode(data, runs, len(x)).tolist() == values
