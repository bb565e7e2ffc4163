import gzip
import hashlib
import io
from collections import defaultdict

from pyspark.sql import functions as F
from quillon.llm import warc as R


def test_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(900, None, None), (901, "u\r\nX: y", ""), (902, "u", rows[0][2]), (903, "v", "é" * 1500), (904, "v", "é" * 1500), (905, "w", "z" * (5 << 20)), (906, "w", "a" * 999), (907, "w", "a" * 999), (904, "v", "é" * 1500), (None, "n", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_id string")
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i if i is not None else -1)
    want = []
    for i, _, h in rows:
        p, top = (h or "").encode(), max(by[h or ""])
        again = len(p) >= 1000 and i is not None and i != top
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in R.op3_warc(df).collect()), key=key) == sorted(want, key=key)
    assert R.op3_warc(df.limit(0)).count() == 0


def test_a_page_id_with_several_payloads(spark):
    """Each payload of a page_id is judged by itself, and every payload is in full in some record."""
    a, b, c = ("abc"[i] * 1200 for i in range(3))
    for rows in ([(5, a), (5, b), (9, a)], [(5, a), (5, c), (9, a), (10, c)], [(5, a), (5, a), (7, a), (7, b), (7, "short"), (None, a)]):
        df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
        top = {p: max(i for i, x in rows if x == p and i is not None) for _, p in rows}
        want = []
        for i, p in rows:
            again = len(p) >= 1000 and i is not None and i < top[p]
            want.append((i, len(p), hashlib.sha1(p.encode()).hexdigest(), "revisit" if again else "response", top[p] if again else None))
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        got = sorted((tuple(r) for r in R.op3_warc(df).collect()), key=key)
        assert got == sorted(want, key=key)
        assert {r[2] for r in got if r[3] == "response"} == {r[2] for r in got}


def test_chunks_carry_digests():
    data = bytes(range(256)) * 700
    head = R.header("response", "5", "u", len(data), hashlib.sha1(data).digest(), len(data), None)
    raw = b"".join(R.gzip_member(R.record(head, data, 1000), 3)) * 2
    assert gzip.decompress(raw).startswith(R.MARK)
    own = list(R.chunks(io.BytesIO(raw), 1 << 15))
    first = [c for c in own if c.ordinal == 0]
    assert b"".join(c.data for c in first) == data and len(own) == 2 * len(first) > 4
    at = 0
    for c in first:
        at += len(c.data)
        assert c.size == at and c.sha1 == hashlib.sha1(data[:at]).hexdigest() and len(c.data) <= 1 << 17
    assert [c.last for c in first] == [False] * (len(first) - 1) + [True]
