"""Token operators against the libraries: word encoder, packed files, packing, pieces."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from teleproof.llm import packing, pieces, token_files, tokens
from teleproof.llm.queries import PIECE_BPE, QUERIES, WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)
ODD = ["", " ", "it's  I'LL\tx", "é ́a <|endoftext|>a<|startoftext|> b\x1cc\x85d", "12 ½ Σας ΟΔΟΣ 'S\nre're", "a..b,c!? d...", "İstanbul Å ß", "a " * 5000]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def test_word_encoder(documents):
    words = tokens.WordEncoder(WORD_BPE, keep=50)
    assert words.plain
    for text in [*ODD, *(t for _, t, _ in documents)]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert words.encode(None) == b"" and len(words) <= 51


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8) and (token_files.unpack(data, bits, 1000) == ids).all()
    assert token_files.bits_for(2**bits) == bits


def test_random_access(tmp_path):
    ids = [np.arange(k * 7 % 50_000, dtype="<u4") for k in range(12_000, 12_030)]
    with open(tmp_path / "x.bin", "wb") as out:
        writer = token_files.PackedWriter(out, 17)
        for k, part in enumerate(ids):
            writer.add(None if k == 3 else k, part)
        writer.close()
    reader, flat = token_files.PackedReader(str(tmp_path / "x.bin")), np.concatenate(ids)
    for a, b in [(0, 0), (0, 1), (65_535, 65_537), (100_000, 400_000), (len(flat) - 1, len(flat))]:
        assert (reader.ids(a, b) == flat[a:b]).all()
    assert [d for d, _, _ in reader.documents(step=1000)] == [None if k == 3 else k for k in range(30)]


def test_op5_round_trip(spark, sf, documents):
    start = 0
    for row, (doc, text, _) in zip(QUERIES["op5_token_files"](spark, sf).orderBy("doc_id").collect(), sorted(documents)):
        ids = encoded(text, 2)
        assert tuple(row) == (doc, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_edges(frame):
    rows = [(None, "x"), (2, None), (1, ""), (1, "b a"), (1, "b a"), (5, "w " * 9000)]
    got = token_files.token_files(frame(rows, start="clash"), WORD_BPE, 2).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 1), (1, 3), (1, 3), (2, 1), (5, 9001)]
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert token_files.token_files(frame([]), WORD_BPE, 2).collect() == []


def held(rows, documents, size, end):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in documents:
        ids, at = encoded(text, end), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return 1 - sum(r.length for r in rows) / size / len(by_sequence)


def test_op2(spark, sf, documents):
    rows = QUERIES["op2_packing"](spark, sf).collect()
    assert held(rows, [(d, t) for d, t, _ in documents], 2048, 1) < 0.05


@pytest.mark.parametrize("group", [2, 1024])
def test_packing_edges_and_rounds(frame, monkeypatch, group):
    monkeypatch.setattr(packing, "MERGE_GROUP", group)
    random.seed(1)
    rows = [(k, "a " * random.randrange(0, 90)) for k in range(200)] + [(200, None), (201, ""), (202, "a " * 3000)]
    got = packing.pack_tokens(frame(rows, offset="clash").repartition(7), packing.word_ids(WORD_BPE, 1), size=64, open_windows=3, least_cut=8).collect()
    held(got, rows, 64, 1)
    assert packing.pack_texts(frame([]), WORD_BPE, 1).collect() == []


def test_open_windows_best_fit():
    windows = packing.OpenWindows(10, 2, 3, 0)
    assert list(windows.place(6)) == [(6, 0, 0)] and list(windows.place(8)) == [(8, 1, 0)]
    assert list(windows.place(2)) == [(2, 1, 8)]  # fills the tighter one
    assert list(windows.place(9)) == [(9, 2, 0)]
    assert list(windows.place(7)) == [(7, 3, 0)]  # the fullest had too little room for a cut and was emitted
    assert windows.room == [(3, 3), (4, 0)]


PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def test_pieces_match_the_library(documents):
    model = pieces.PieceTransducer(PIECE_BPE, keep=500)
    random.seed(3)
    letters = "ab e tionrs  ▁\n\té日本語Ａ½<>/0x.,aaabth"
    made = ["".join(random.choice(letters) for _ in range(random.randrange(30))) for _ in range(3000)]
    for text in [*made, *ODD, "x  ", "  x", "<s>hi</s> <0x41>", "x\x00y", *(t for _, t, _ in documents)]:
        ids = np.frombuffer(model.encode(text), "<u4").tolist()
        assert ids == PIECES.encode(text) and model.decode(model.encode(text)) == PIECES.decode(ids)


def test_op1(spark, sf, documents):
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op1_pieces"](spark, sf).collect()}
    for doc, text, _ in documents:
        ids = PIECES.encode(text)
        assert tuple(got[doc]) == (doc, len(ids), crc(ids), hashlib.sha256(text.encode()).hexdigest())


def test_pieces_edges(frame):
    rows = [(None, "a"), (1, None), (2, ""), (2, ""), (3, "a b " * 4000)]
    back = pieces.decode_pieces(pieces.encode_pieces(frame(rows, ids="clash"), PIECE_BPE), PIECE_BPE).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in back) == [(0, "a"), (1, ""), (2, ""), (2, ""), (3, "a b " * 4000)]
    assert pieces.encode_pieces(frame([]), PIECE_BPE).collect() == []


def test_files_of_one_id_stay_in_order(spark, frame):
    """One id and null ids fill several files each; starts go up with the id."""
    rows = [(d, f"text {k} of {d}") for d, n in ((None, 200), (5, 400), (6, 1), (9, 60)) for k in range(n)]
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "false")
        spark.conf.set(keys[1], "12")
        got = token_files.token_files(frame(rows), WORD_BPE, end_id=2).orderBy("start").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == len(rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
