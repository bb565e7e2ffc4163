import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon.llm import suffixes as S


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.text("ab", max_size=120).map(str.encode)))
def test_suffix_order(data):
    order = S.two_stage(np.frombuffer(data, np.uint8), len(data) + 1)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    lcp = S.common_prefixes(np.frombuffer(data, np.uint8), order, len(data) + 1)
    for a, b, n in zip(want, want[1:], lcp):
        m = min(len(data) - a, len(data) - b)
        k = next((i for i in range(m) if data[a + i] != data[b + i]), m)
        assert min(n, m) == k


def brute(rows, n):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        mark = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - n + 1):
            x = t[a : a + n]
            if x in seen:
                mark[a : a + n] = True
            seen.add(x)
        edges = np.flatnonzero(np.diff(np.r_[False, mark].astype(int)) == 1)
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((rows[i][0], len(t), int(mark.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def check(spark, rows, n=100):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, start int").coalesce(1)
    got = sorted((tuple(r) for r in S.op4_suffix_dedup(df, n).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[4]))
    assert got == brute(rows, n)
    return df


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    for k in range(25):
        a = rnd.randrange(2600)
        rows.append((1000 + k, long[:40] + long[a : a + rnd.randrange(90, 400)] + "é" * rnd.randrange(30) + long[: rnd.randrange(130)]))
    rows += [(2000, "ab" * 400), (2001, "a" * 99), (2002, "a" * 260), (2003, None), (None, long), (None, "x" + long), (2004, ""), (2005, rows[3][1]), (2005, rows[3][1]), (7, rows[3][1] + "!")]
    df = check(spark, rows)
    assert S.op4_suffix_dedup(df.limit(0)).count() == 0


def test_crowded_groups_and_small_pieces():
    rnd = random.Random(6)
    runs = [bytes(rnd.choice(b"ab") for _ in range(130)) for _ in range(40)]
    text = np.frombuffer(b"".join(runs + runs[:9]), np.uint8)
    begin, count = np.arange(49) * 130, np.full(49, 31)
    S.SIDE_BY_SIDE, held = 7, S.SIDE_BY_SIDE
    one, two = (np.sort(f(text, begin, count, 100)) for f in (S.later_strings, S.later_crowded))
    S.SIDE_BY_SIDE = held
    seen, want = set(), []
    for a in (begin[:, None] + np.arange(31)).ravel().tolist():
        x = text[a : a + 100].tobytes()
        want += [a] * (x in seen)
        seen.add(x)
    assert one.tolist() == two.tolist() == want and len(want) >= 9 * 31


def test_segments_and_batches(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 500)
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"abcd") for _ in range(4000))
    whole = S.minimizers(text, 100)
    monkeypatch.setattr(S, "SEGMENT", 1 << 21)
    one = S.minimizers(text, 100)
    spread = lambda x: [h for h, m in zip(x[0].tolist(), x[2].tolist()) for _ in range(m)]
    assert spread(whole) == spread(one) and len(spread(one)) == 3901
