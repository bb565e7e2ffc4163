import random

import numpy as np
import xxhash
from quillon.llm import simhash as S
from quillon.llm.components import components, forest


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", w)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    fp = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, f"{fp[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, ""), (902, " \t\n"), (903, "one TWO"), (904, "one two"), (905, "x " * 30000)]
    extra = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted(tuple(r) for r in S.op2_simhash(extra).collect())
    assert got == brute(rows)
    assert S.op2_simhash(extra.limit(0)).count() == 0
    kept = {r.doc_id for r in S.deduplicated(extra).collect()}
    assert kept == {c for _, _, c in got}


def test_dense_prints_link_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 8)
    rnd = random.Random(5)
    centre = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centre for _ in range(60)} | {0, (1 << 64) - 1}
    own = np.array(sorted(prints), np.uint64)
    a, b = zip(*((x, y) for x in own for y in own if x < y and int(x ^ y).bit_count() <= 4))
    want = dict(zip(*(z.tolist() for z in forest(np.array(a), np.array(b)))))
    for blocks in range(5, 9):
        got_a, got_b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for m in S.block_masks(blocks, 4):
            for x, y in S.close_pairs(own & np.uint64(m), own, 4, ~m & (1 << 64) - 1):
                got_a, got_b = np.r_[got_a, x], np.r_[got_b, y]
        assert dict(zip(*(z.tolist() for z in forest(got_a, got_b)))) == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(9)] + [(100, 99), (98, 99), (7, 7), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 10)}, 99: 98, 100: 98, 300: 200}
