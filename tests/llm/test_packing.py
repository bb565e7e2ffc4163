import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon.llm import packing as K
from quillon.llm.bpe import encoder
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", " lead", "trail ", "x\n y", "x \n  y\t z", "it's  we'll", "\x1c a\x85b", "<|endoftext|> a", "　全角 文字", "​ b", "a" * 5000, "é́ ñ", "1 234 5 ６", "a  b  c", "\r\n x\x0b y"]


def test_ids_are_the_tokenizer_s(spark, sf):
    t = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    for x in texts:
        assert np.frombuffer(encoder(PATH).encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_packs_all_pieces(spark, sf):
    t = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text, 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None, 1), (900, "", 1), (901, "x y " * 9000, 1), (0, rows[0][1], 1)]
    got = K.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string, piece int")).collect()
    want = defaultdict(int)
    for d, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    have = defaultdict(int)
    at = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        at[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for own in at.values():
        end = 0
        for a, n in sorted(own):
            assert a == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(at) <= 1.02 * -(-total // 2048) + 1
    assert K.packed_pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    p = K.plan(counts, 64)
    rank = defaultdict(set)
    fill = defaultdict(int)
    for length, first, k, offset in p.slots.tolist():
        for i in range(p.times[k]):
            assert first + i not in rank[length]
            rank[length].add(first + i)
            fill[p.sequences[k] + i] += length
    assert {x: len(r) for x, r in rank.items()} == {x: int(n) for x, n in enumerate(counts) if n}
    assert all(v <= 64 for v in fill.values())


def test_exact_complements_first():
    p = K.plan(np.bincount([60, 4, 50, 10, 4, 30, 20, 10, 4], minlength=65), 64)
    assert p.times.sum() == 3
