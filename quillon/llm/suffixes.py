"""Exact repeated strings by suffix arrays: two-stage sorting over the text around repeated minimizers.

A string of `length` bytes is dealt by its minimizer, the k-mer of the smallest hash in it, which its content alone
decides. Only runs of strings whose minimizer occurs twice in the corpus can repeat; their bytes meet in the task of
that minimizer, where a suffix array and the common prefixes of its neighbours find equal strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, packed, parts, runs, stored, unpacked
from .lines import NULL_ID, ranges

LENGTH = 100
K = 16
#: Bytes of text that a suffix array is built over at once.
BATCH = 1 << 20
#: Bytes of one minimizer's runs beyond which they get no suffix array, as it needs tens of bytes for each.
CROWDED = 2 << 20
#: Bytes whose minimizers are found at once; fewer than 2**22, as positions share a word with hashes.
SEGMENT = 1 << 19
#: Strings whose bytes are laid side by side at once to be sorted; those of one two-byte beginning are never parted.
SIDE_BY_SIDE = 100_000
POSITION = np.uint64((1 << 22) - 1)


def by_beginning(text: np.ndarray, at: np.ndarray, depth: int):
    """(positions, their strings of `depth` bytes) in the order of the first two bytes, some beginnings at a time."""
    padded = np.r_[text, np.zeros(depth + 1, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    two = padded[at].astype(np.uint16) << 8 | padded[at + 1]
    order = np.argsort(two, kind="stable")
    at, two = at[order], two[order]
    starts, sizes = runs(two)
    lo = 0
    while lo < len(starts):
        hi, n = lo + 1, int(sizes[lo])
        while hi < len(starts) and n + sizes[hi] <= SIDE_BY_SIDE:
            n += int(sizes[hi])
            hi += 1
        own = at[starts[lo] : starts[lo] + n]
        yield own, np.ascontiguousarray(view[own]).view(f"S{depth}").ravel()
        lo = hi


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of text (uint8), in the order of the suffixes' first `depth` bytes.

    Suffixes smaller than their successors are sorted directly. The others follow from them: scanned bucket by
    bucket, each sorted suffix places the one before it, if that is larger, at the end of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ahead = np.r_[text[1:].astype(np.int16), -1]
    differs = np.where(text != ahead, np.arange(n), n)
    at = np.minimum.accumulate(differs[::-1])[::-1]  # where the run of equal bytes ends
    smaller = text[at].astype(np.int16) < ahead[at]
    direct = np.flatnonzero(smaller)
    del differs, at, ahead
    direct = np.concatenate([np.zeros(0, np.int64), *(x[np.argsort(keys, kind="stable")] for x, keys in by_beginning(text, direct, depth))])
    first = text[direct]
    begin = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[n - 1])].append(np.array([n - 1]))  # the last suffix is larger than the empty one
    out = []
    for c in range(256):
        chain = [np.concatenate(waiting[c])] if waiting[c] else []
        while chain and len(chain[-1]):
            before = chain[-1][chain[-1] > 0] - 1
            chain.append(before[(text[before] == c) & ~smaller[before]])
        bucket = np.concatenate([*chain, direct[begin[c] : begin[c + 1]]]) if chain else direct[begin[c] : begin[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            s, m = runs(text[before])
            for a, x in zip(s, m):
                waiting[int(text[before[a]])].append(before[a : a + x])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each entry of order but the first: how many bytes, up to depth, its suffix shares with the one before."""
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for a in range(0, len(out), 1 << 16):
        same = view[order[a : min(len(order) - 1, a + (1 << 16))]] == view[order[a + 1 : a + 1 + (1 << 16)]]
        out[a : a + len(same)] = np.where(same.all(1), depth, same.argmin(1))
    return out


def minimizers(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, count) of the runs of starts whose strings of `length` bytes have the same minimizer."""
    hashes, starts, counts = [], [], []
    width = length - K + 1
    for lo in range(0, len(text) - length + 1, SEGMENT):
        part = text[lo : lo + SEGMENT + length - 1]
        n = len(part) - K + 1
        word = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        with np.errstate(over="ignore"):
            h = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (word[8 : 8 + n] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        low = (h & ~POSITION) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & POSITION).astype(np.int64)
        s, m = runs(at)
        hashes.append(h[at[s]])
        starts.append(s + lo)
        counts.append(m)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)


def deal_runs(n_parts: int, length: int):
    def work(batches):
        for b in batches:
            got, size = [], 0
            for row, t in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if t and len(t) >= length:
                    h, s, m = minimizers(t, length)
                    got.append((h, np.full(len(h), row, np.int64), s, m))
                    size += len(h)
                if size > 200_000:
                    yield pack_runs(got, n_parts)
                    got, size = [], 0
            if got:
                yield pack_runs(got, n_parts)

    return work


def pack_runs(got, n_parts: int) -> pa.RecordBatch:
    h, row, s, m = (np.concatenate(x) for x in zip(*got))
    return packed((mix(h) % np.uint64(n_parts)).astype(np.int32), hash=h, row=row, start=s.astype(np.uint32), count=m.astype(np.uint8))


RUNS = {"hash": "u8", "row": "i8", "start": "u4", "count": "u1"}
RUNS_SCHEMA = "part int, hash binary, row binary, start binary, count binary"


def repeated_runs(n_parts: int):
    """The runs whose minimizer occurs more than once, packed by row."""

    def work(batches):
        got = unpacked(batches, **RUNS)
        order = np.argsort(got["hash"], kind="stable")
        _, n = runs(got["hash"][order])
        keep = order[np.repeat(n > 1, n)]
        for a in range(0, len(keep), 1 << 20):
            x = keep[a : a + (1 << 20)]
            yield packed((mix(got["row"][x]) % np.uint64(n_parts)).astype(np.int32), **{c: got[c][x] for c in RUNS})

    return work


def by_row(kinds: dict[str, str]):
    """Packed entries to a row for each value of row."""

    def work(batches):
        got = unpacked(batches, **kinds)
        order = np.lexsort((got["start"], got["row"]))
        s, m = runs(got["row"][order])
        names = [c for c in kinds if c != "row"]
        for a in range(0, len(s), 5000):
            cols = [[got[c][order[x : x + y]].tobytes() for x, y in zip(s[a : a + 5000], m[a : a + 5000])] for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(got["row"][order[s[a : a + 5000]]]), *(pa.array(c, pa.binary()) for c in cols)], names=["row", *names])

    return work


STRINGS = "part int, hash binary, doc binary, row binary, start binary, count binary, data binary"


def deal_strings(n_parts: int, length: int):
    """The bytes of each repeated run's strings, packed by minimizer."""
    names = [x.split()[0] for x in STRINGS.split(", ")]

    def send(got):
        cols = [np.concatenate(x) for x in zip(*got)]
        h, doc, row, start, count, data = cols
        part = (mix(h) % np.uint64(n_parts)).astype(np.int32)
        size = count.astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        order = np.argsort(part, kind="stable")
        s, m = runs(part[order])
        data = data[ranges(at[order], size[order])]
        end = np.r_[0, np.cumsum(size[order])]
        arrays = [pa.array(part[order[s]], pa.int32())]
        arrays += [pa.array([c[order[a : a + x]].tobytes() for a, x in zip(s, m)], pa.binary()) for c in (h, doc, row, start, count)]
        arrays.append(pa.array([data[end[a] : end[a + x]].tobytes() for a, x in zip(s, m)], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def work(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            got, size = [], 0
            for doc, row, t, h, s, m in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "text", "hash", "start", "count"))):
                text = np.frombuffer(z.decompress(t), np.uint8)
                h, s, m = np.frombuffer(h, "u8"), np.frombuffer(s, "u4").astype(np.int64), np.frombuffer(m, "u1")
                for a in range(0, len(h), 10_000):
                    i, j = s[a : a + 10_000], m[a : a + 10_000]
                    data = text[ranges(i, j.astype(np.int64) + length - 1)]
                    got.append((h[a : a + 10_000], np.full(len(i), NULL_ID if doc is None else doc, np.int64), np.full(len(i), row, np.int64), i.astype(np.uint32), j, data))
                    size += len(data)
                    if size > BATCH:
                        yield send(got)
                        got, size = [], 0
            if got:
                yield send(got)

    return work


def later_strings(text: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Positions in text of strings that also start earlier in it. Run i stands at begin[i] with count[i] strings."""
    valid = np.zeros(len(text), bool)
    valid[ranges(begin, count)] = True
    order = two_stage(text, length)
    order = order[valid[order]]
    group = np.r_[0, np.cumsum(common_prefixes(text, order, length) < length)]
    order = order[np.lexsort((order, group))]
    return order[np.r_[False, group[1:] == group[:-1]]]


def later_crowded(text: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """The same for the runs of one minimizer that are too many for a suffix array: their strings alone are sorted."""
    out = []
    for at, keys in by_beginning(text, ranges(begin, count), length):
        order = np.argsort(keys, kind="stable")
        out.append(at[order[np.r_[False, keys[order][1:] == keys[order][:-1]]]])
    return np.concatenate(out)


def find_repeats(n_parts: int, length: int):
    """Runs of starts whose strings start earlier elsewhere, packed by row."""

    def work(batches):
        got = {c: [] for c in ("hash", "doc", "row", "start", "count", "data")}
        for b in batches:
            for c in got:
                got[c] += b.column(c).to_pylist()
        h, doc, row, start, count = (np.frombuffer(b"".join(got[c]), t) for c, t in (("hash", "u8"), ("doc", "i8"), ("row", "i8"), ("start", "u4"), ("count", "u1")))
        data = b"".join(got.pop("data"))
        got.clear()
        count = count.astype(np.int64)
        size = count + length - 1
        at = np.cumsum(size) - size
        order = np.lexsort((start, row, doc, h))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pending: list[np.ndarray] = []
        held = 0
        raw = np.frombuffer(data, np.uint8)

        def solve(leads, find=later_strings):
            # runs of a minimizer follow each other by doc, row and start, so earlier in text is earlier in the corpus
            text = raw[ranges(at[leads], size[leads])]
            begin = np.cumsum(size[leads]) - size[leads]
            found = np.sort(find(text, begin, count[leads], length))
            if len(found):
                run = np.searchsorted(begin, found, "right") - 1
                s, m = runs(found - np.arange(len(found)) + run * (len(text) + length))
                first, run = found[s], run[s]
                out.append((row[leads][run], start[leads][run] + (first - begin[run]), m))

        s, m = runs(h[order])
        again = []
        for a, x in zip(s, m):
            own, seen, leads = order[a : a + x], {}, []
            for i in own.tolist():
                key = data[at[i] : at[i] + size[i]]
                if key in seen:
                    again.append(i)
                else:
                    seen[key] = i
                    leads.append(i)
            if len(leads) > 1 and int(size[leads].sum()) > CROWDED:
                solve(np.array(leads), later_crowded)
            elif len(leads) > 1:
                pending.append(np.array(leads))
                held += int(size[leads].sum())
                if held > BATCH:
                    solve(np.concatenate(pending))
                    pending, held = [], 0
        if pending:
            solve(np.concatenate(pending))
        again = np.array(again, np.int64)
        out.append((row[again], start[again], count[again]))
        r, s, m = (np.concatenate([x[i] for x in out]) for i in range(3))
        for a in range(0, len(r), 1 << 20):
            x = slice(a, a + (1 << 20))
            yield packed((mix(r[x]) % np.uint64(n_parts)).astype(np.int32), row=r[x].astype(np.int64), start=s[x].astype(np.uint32), count=m[x].astype(np.uint32))

    return work


def spans_of(start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Disjoint byte ranges that the strings at these runs of starts cover."""
    a, b = start.astype(np.int64), start.astype(np.int64) + count + length - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return np.stack([a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]], 1)


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text (bytes under zstandard) and spans (pairs of longs, packed; null if none) for every row of docs.

    The spans are the bytes covered by strings of `length` bytes that also start earlier: in a smaller doc_id
    (nulls first), an earlier row of it, or earlier in the text. Runs of equal bytes are merged where they meet.
    """
    if length < 2 * K:
        raise ValueError(f"length must be at least {2 * K}")
    n = parts(docs)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    first = rows.select("row", "text").mapInArrow(deal_runs(n, length), RUNS_SCHEMA).repartition(n, "part")
    again = first.mapInArrow(repeated_runs(n), RUNS_SCHEMA).repartition(n, "part")
    again = stored(again.mapInArrow(by_row(RUNS), "row long, hash binary, start binary, count binary"), "runs")

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            own = pa.array([z.compress(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), own], names=["row", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small = rows.select("row", "doc_id", "text").mapInArrow(shrink, f"row long, doc_id {kind}, text binary")
    both = small.join(again, "row").select(F.col("doc_id").cast("long").alias("doc"), "row", "text", "hash", "start", "count")
    found = both.mapInArrow(deal_strings(n, length), STRINGS).repartition(n, "part")
    found = found.mapInArrow(find_repeats(n, length), "part int, row binary, start binary, count binary").repartition(n, "part")
    found = stored(found.mapInArrow(by_row({"row": "i8", "start": "u4", "count": "u4"}), "row long, start binary, count binary"), "repeats")
    return small.join(found, "row", "left").select("doc_id", "text", "start", "count")


def cut(batches, length: int):
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for doc, t, s, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "start", "count"))):
            t = z.decompress(t)
            spans = spans_of(np.frombuffer(s, "u4"), np.frombuffer(m, "u4").astype(np.int64), length) if s else np.zeros((0, 2), np.int64)
            kept, at = [], 0
            for x, y in spans.tolist():
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            yield doc, t, spans, b"".join(kept)


def op4_suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs (doc_id, text).

    Null texts count as empty, and texts under `length` bytes lose nothing. Repeated rows are copies of the first;
    a row with a null doc_id comes before all others. Other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            out = [(d, len(t), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(k).hexdigest()) for d, t, s, k in cut([b], length)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[1:], [pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, length).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and text without the removed bytes; what a cut leaves of a character becomes U+FFFD."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([k.decode("utf-8", "replace") for *_, k in cut([b], length)], pa.string())], names=["doc_id", "text"])

    return removed_spans(docs, length).mapInArrow(work, f"doc_id {kind}, text string")
