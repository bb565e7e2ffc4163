import hashlib
import re

from quillon.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    win = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            win.setdefault(tuple(w[k : k + width]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in docs:
        w, hit, own = split(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in win:
                    hit |= set(range(k, k + n))
                    own |= win[x]
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(500, "a b"), (501, None), (502, ""), (503, "a b"), (500, "x y z"), (None, "only here")]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(900, None), (901, ""), (902, "a b a b A-B"), (904, "it is Only here now"), (902, items[0][1] + " " + items[1][1]), (903, ("a b " * 20000) + items[2][1])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0], r[1:])
    want = sorted(brute(rows, items), key=key)
    assert sum(x[5] for x in want) > 4
    assert sorted((tuple(r) for r in D.op10_decontaminate(d, b).collect()), key=key) == want
    monkeypatch.setattr(D.blocks, "__defaults__", (9000,))
    assert sorted((tuple(r) for r in D.op10_decontaminate(d, b).collect()), key=key) == want
    kept = sorted(r.doc_id for r in D.decontaminated(d, b).collect())
    assert kept == sorted(x[0] for x in want if not x[5])
    none = D.op10_decontaminate(d, b.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    assert D.op10_decontaminate(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two and three four"), (2, "one three two four")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    assert [r.n_hit for r in D.contamination(d, b).orderBy("doc_id").collect()] == [0, 0]
    assert [r.n_hit for r in D.contamination(d, b, slack=1).orderBy("doc_id").collect()] == [5, 0]
