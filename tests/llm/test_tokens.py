"""Token ids, Huffman files and packing against plain encodings."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import huffman as H
from plumbline.llm.packing import pack_documents, pack_group
from plumbline.llm.tokens import TextEncoder

ODD = ["", " ", "  a  b \n c\t d  ", "a\n b  \n\n c <|endoftext|> it's  don't　x   y", "x" * 500, "日本 語 テスト  ", " \n a", "ÀÉ é ñ", "a b", "\x1c x \x85 y", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  <|endoftext| >", "x<|endoftext|>\n <|endo"]


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return TextEncoder(tokenizer)


@pytest.fixture(scope="module")
def fresh(tokenizer):
    """The library's tokenizer as it comes from the file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def plain(fresh, text):
    return fresh.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_ids_of_the_whole_text(encoder, fresh, text):
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == plain(fresh, text)


def test_other_kinds_of_tokenizers_are_refused():
    from plumbline.llm.queries import tokenizer_path

    with pytest.raises(ValueError, match="byte-level"):
        TextEncoder(tokenizer_path("word_bpe_49k.json"))


def test_code_lengths_are_limited_and_complete():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 1000, 0])
    for limit in (4, 5, 9, 12):
        n = H.code_lengths(counts, limit)
        assert n.max() <= limit and (n[counts == 0] == 0).all()
        assert sum(2.0 ** -int(x) for x in n if x) == 1.0
    free = H.code_lengths(counts, 12).astype(int) @ counts
    import heapq

    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert free == cost
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(9), 3)
    assert H.code_lengths(np.array([0, 7]), 4).tolist() == [0, 1] and not H.code_lengths(np.zeros(4), 4).any()


def test_file_round_trip_and_faults():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 5, 1, 700, 2])
    ids = rng.zipf(1.3, sizes.sum()).clip(max=999).astype(np.uint16)
    lengths = H.code_lengths(np.bincount(ids, minlength=1000), 16)
    data = H.pack_file([None, -3, 0, 7, 1 << 60], sizes, ids, lengths, H.canonical(lengths), 16, 64)
    docs, got, back = H.unpack_file(data)
    assert docs == [None, -3, 0, 7, 1 << 60] and got.tolist() == sizes.tolist() and back.tolist() == ids.tolist()
    for bad in (data[:-1], b"x" + data[1:], data[:200] + bytes([data[200] ^ 1]) + data[201:], b""):
        with pytest.raises(ValueError):
            H.unpack_file(bad)


def test_huffman_corpus(spark, docs, rows, empty, tokenizer, encoder, fresh):
    got = H.encode_corpus(docs, tokenizer).orderBy("start").collect()
    want = sorted(((r[0] is not None, r[0] or 0, np.array([*plain(fresh, r[1]), 2], "<u4").tobytes()) for r in rows), key=lambda x: x[:2])
    assert [(g["doc_id"] is not None, g["doc_id"] or 0) for g in got] == [w[:2] for w in want]
    assert sorted(bytes(g["ids"]) for g in got) == sorted(w[2] for w in want)
    at = 0
    for g in got:
        assert g["start"] == at and g["n_tokens"] * 4 == len(g["ids"])
        at += g["n_tokens"]
    assert H.encode_corpus(empty, tokenizer).count() == 0


def test_pack_group_places_every_token_once():
    for sizes in ([], [0], [1], [1024], [1023, 1, 1, 5000], [700] * 9, list(range(1, 200))):
        sizes = np.array(sizes, np.int64)
        seen, fill = defaultdict(list), defaultdict(list)
        for k, a, n, seq, off in pack_group(sizes, 1024):
            seen[k].append((a, n))
            fill[seq].append((off, n))
        for k, n in enumerate(sizes):
            at = 0
            for a, m in sorted(seen[k]):
                assert a == at and m > 0
                at += m
            assert at == n
        for spans in fill.values():
            at = 0
            for off, n in sorted(spans):
                assert off == at
                at += n
            assert at <= 1024
        assert len(fill) == (sizes // 1024).sum() + -(-(sizes % 1024).sum() // 1024)


def test_pack_group_balances_cost():
    fill = defaultdict(float)
    rng = np.random.default_rng(1)
    for _, _, n, seq, _ in pack_group(rng.integers(1, 300, 600), 1024):
        fill[seq] += n + n * n / 1024
    cost = np.array(list(fill.values()))
    assert cost.std() / cost.mean() < 0.15


def test_pack_documents(spark, docs, rows, empty, tokenizer, encoder, fresh):
    got = pack_documents(docs, tokenizer).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for g in got:
        by_doc[(g["doc_id"], g["doc_tokens"])].append((g["start"], bytes(g["ids"])))
        by_seq[g["sequence_id"]].append((g["offset"], g["length"]))
        assert len(g["ids"]) == 4 * g["length"]
    want = defaultdict(list)
    for r in rows:
        ids = np.array([*plain(fresh, r[1]), 0], "<u4")
        want[(r[0], len(ids))].append(ids.tobytes())
    assert sum(g["length"] for g in got) == sum(k[1] * len(v) for k, v in want.items())
    for key, texts in want.items():
        if len(texts) == 1:
            assert b"".join(x for _, x in sorted(by_doc[key])) == texts[0]
    for spans in by_seq.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= 1024
    assert pack_documents(empty, tokenizer).count() == 0
    assert zlib.crc32(bytes(got[0]["ids"])) >= 0


def test_a_mark_after_a_word_costs_no_merges_of_its_own():
    import public_tokenizers

    from plumbline.llm.tokens import TextEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, asked = TextEncoder(path), []
    merge = enc.merge
    enc.pieces.merge = lambda w: (asked.append(w), merge(w))[1]
    text = "x zorbel zorbel, zorbel. zorbel! étélin étélin; жук жук, a1b, , ... ½. zorbel"
    import numpy as np

    assert np.frombuffer(enc.encode(text), "<u2").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert asked == ["Ġzorbel", "ĠÃ©tÃ©lin"]
