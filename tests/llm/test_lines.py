import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quillon.llm import lines as L
from quillon.llm.common import packed, squeezed

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def matches(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = [], []
    for i in order:
        own = [] if rows[i][1] is None else rows[i][1].split("\n")
        kept = []
        for x in own:
            w = frozenset(W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
            if w and any(5 * len(w & u) >= 4 * len(w | u) for u in seen if 5 * len(u) >= 4 * len(w) and 5 * len(w) >= 4 * len(u)):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            kept.append(x)
        out.append((rows[i][0], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_against_brute_force(spark, sf, monkeypatch):
    rnd = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"t{i}" for i in range(12)]
    family = ["\n".join(" ".join(rnd.sample(base, 12)[: rnd.randint(9, 12)] + rnd.sample(["x", "y", "z", "v"], rnd.randint(0, 2))) for _ in range(3)) for _ in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(family)]
    rows += [(None, None), (2000, ""), (2001, "\n\n --- \n"), (None, "Zero one\nzero ONE!"), (2002, "w " * 40000 + "\n" + " ".join(f"u{i}" for i in range(9000))), (1001, family[1]), (2003, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, n_lines int").coalesce(1)
    got = sorted((tuple(r) for r in L.op1_line_dedup(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    assert got == matches(rows)
    assert L.op1_line_dedup(df.limit(0)).count() == 0
    for other in ({"SECOND_ROUND": 1, "GROWTH": 2}, {"HOT": 2, "BROADCAST_IDS": 0}):
        with monkeypatch.context() as m:
            for name, value in other.items():
                m.setattr(L, name, value)
            got = sorted((tuple(r) for r in L.op1_line_dedup(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        assert got == matches(rows), other


def test_pieces_of_a_crowd(monkeypatch):
    """Candidates of one token's sets, looked at in pieces, are those of all pairs."""
    rnd = np.random.default_rng(5)
    n = 400
    doc, size = rnd.integers(0, 50, n), rnd.integers(5, 40, n)
    got = {"key": rnd.integers(0, 3, n).astype("u8") << L.SIZE | size.astype("u8"), "id": np.arange(n) + 7, "doc": doc, "n": size.astype("u4"), "place": rnd.integers(0, 3, n).astype("u4"), "low": rnd.integers(0, 4, n).astype("u8"), "high": rnd.integers(0, 4, n).astype("u8")}
    order = np.argsort(got["key"], kind="stable")
    row = squeezed(packed(np.zeros(n, np.int32), **{c: v[order] for c, v in got.items()}), key="u8", **L.SMALL)
    monkeypatch.setattr(L, "PAIRS", 30)
    found = [x for b in L.candidates(0, 1 << 40, False)([row]) for x in zip(*(c.to_pylist() for c in b.columns[:2]))]
    a, b = np.meshgrid(order, order, indexing="ij")
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    fits = (got["key"][a] >> L.SIZE == got["key"][b] >> L.SIZE) & (a != b) & (doc[b] <= doc[a]) & (5 * small >= 4 * large)
    fits &= 9 * np.minimum(size[a] - got["place"][a], size[b] - got["place"][b]) >= 4 * (size[a] + size[b])
    fits &= 9 * (np.bitwise_count(got["low"][a] ^ got["low"][b]).astype(int) + np.bitwise_count(got["high"][a] ^ got["high"][b])) <= size[a] + size[b]
    every = sorted(zip((a[fits] + 7).tolist(), (b[fits] + 7).tolist()))
    assert sorted(found) == every
    parts = [x for lo, hi in ((0, 2), (2, 9), (9, 1 << 40)) for b in L.candidates(lo, hi, False)([row]) for x in zip(*(c.to_pylist() for c in b.columns[:2]))]
    assert sorted(parts) == every
    began = [x for b in L.candidates(0, 1, True)([row]) for x in zip(*(c.to_pylist() for c in b.columns[:2]))]
    assert set(began) <= set(every) and {x for x, _ in began} == {x for x, _ in every}


def test_hashes_of_words():
    """Words hash alike wherever they stand, with either case of A-Z, at any length."""
    own = [b"Ab " * 200_000 + b"x" * 10_000 + b" ab", b"aB\nba " + b"X" * 10_000, "Ä ä".encode()]
    pieces = list(L.word_sets(own))
    sets = {}
    for text, line, size, token in pieces:
        for t, k, w in zip(text.tolist(), line.tolist(), np.split(token, np.cumsum(size)[:-1])):
            sets[t, k] = set(w.tolist())
    assert [len(x) for x in sets.values()] == [2, 1, 2, 2]
    assert sets[1, 0] < sets[0, 0] and len(sets[0, 0] & sets[1, 1]) == 1 and not sets[2, 0] & sets[0, 0]


def test_share_of_the_second_round():
    """Few sets left take many candidates each, many take SECOND_ROUND; it takes no more than a third round would."""
    assert L.second(1000, 1000) == max(L.SECOND_ROUND, L.SHARE)
    assert L.second(10, 1000) == L.SECOND_ROUND
    assert L.second(20_000, 1000) == 20 * L.SHARE
    assert L.second(10**9, 1) == L.SECOND_ROUND * L.GROWTH


def test_work_of_later_rounds(monkeypatch):
    """A later round seeks the partners of the sets that are left, not of all."""
    n, seen = 300, []
    got = {"key": np.sort(np.arange(n) % 3).astype("u8") << L.SIZE | np.uint64(10), "id": np.arange(n) + 7, "doc": np.arange(n), "n": np.full(n, 10, "u4"), "place": np.zeros(n, "u4"), "low": np.zeros(n, "u8"), "high": np.zeros(n, "u8")}
    row = squeezed(packed(np.zeros(n, np.int32), **got), key="u8", **L.SMALL)
    monkeypatch.setattr(L, "needed", lambda n, own=L.needed: seen.append(np.size(n)) or own(n))
    only = type("Held", (), {"value": np.array([3, 12, 57, 4000])})
    found = [x for b in L.candidates(0, 1 << 40, False, only)([row]) for x in zip(*(c.to_pylist() for c in b.columns[:2]))]
    assert sorted(found) == [(12, 7 + i) for i in range(5)] + [(57, 7 + i) for i in range(50)]
    assert sum(seen) == 2


def test_work_of_prefixes(monkeypatch):
    """Only the words of prefixes are mixed anew, not all words of all sets."""
    seen, n = [], np.array([40, 30, 3])
    token = np.concatenate([np.sort(L.mix(np.arange(k) + 5) >> np.uint64(16)) for k in n])
    block = pa.RecordBatch.from_pydict({"base": [0], "doc": [np.arange(3).tobytes()], "n": [n.astype("u4").tobytes()], "tokens": [L.narrow(token).tobytes()]})
    monkeypatch.setattr(L, "mix", lambda x, seed=0, own=L.mix: seen.append(len(x)) or own(x, seed))
    held = type("Held", (), {"value": np.full(L.COUNTERS, 5, np.uint8)})
    out = list(L.prefixes(held, 4, L.HOT)([block]))
    assert sum(len(x) // L.WIDE for b in out for x in b.column("token").to_pylist()) == 9 + 7
    assert sum(seen) == 9 + 7
