"""Line dedup: an exact set-similarity join of lines by rarity-ordered prefixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix, packed, packed_schema, parts, runs, slices, squeezed, stored, texts, tidy, unpacked, unsqueezed
from .decontaminate import WORDS, words

#: Lines match at this Jaccard similarity of their word sets: NUM / DEN.
NUM, DEN = 4, 5
#: Sets of fewer words match equal sets only: 4 words of 5 is the smallest match of unequal ones.
LEAST = 4
#: Counters of the words' rarity; words share them by hash, which changes no result, only how selective prefixes are.
COUNTERS = 1 << 23
CUTS = 64
#: Words in at least so many sets stand in the shuffle together with a second word of their set.
HOT = 4096
#: Bytes of a word's hash.
WIDE = 6
NULL_ID = -(1 << 63)

#: Bytes of text whose words are found together, which fit into a core's cache.
CACHED = 1 << 18
#: Words beyond so many bytes are hashed one by one.
LONG = 256
#: What stays of eight bytes where a word has fewer.
BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hashes(low: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words low[start:end], the same for the same word anywhere: eight bytes at a time are
    mixed with the hash of those before. Words have no zero bytes, so those behind a shorter word say its length."""
    size = end - start
    eight = np.ndarray(len(low), "<u8", low + bytes(8), strides=1)
    out = mix(eight[start] & BYTES[np.minimum(size, 8)], 1)
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        out[at] = mix(out[at] ^ eight[start[at] + k] & BYTES[np.minimum(size[at] - k, 8)], 1)
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(low[start[i] : end[i]], 42)
    return out


def word_sets(own: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, line, size of its word set, words as ascending 48-bit hashes) of the lines with words, in pieces."""
    raw = b"\n".join(own) + b"\n"
    low = raw.translate(WORDS)
    inside = np.zeros(len(raw) + 1, bool)
    np.not_equal(np.frombuffer(low, np.uint8), 0x20, out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = np.ascontiguousarray(edge[::2]), np.ascontiguousarray(edge[1::2])
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    count = np.diff(np.r_[0, np.searchsorted(start, ends)])
    size = np.array([len(t) + 1 for t in own])
    first = np.searchsorted(ends, np.cumsum(size) - size)  # each text's first line
    word = hashes(low, start, end) >> np.uint64(64 - 8 * WIDE)
    lines = np.flatnonzero(count)
    bound = np.r_[0, np.cumsum(count[lines])]
    for a in range(0, len(lines), 60_000):  # a line's number in the piece and a word's hash fit into 64 bits
        x = lines[a : a + 60_000]
        key = np.repeat(np.arange(len(x), dtype=np.uint64) << np.uint64(8 * WIDE), count[x]) | word[bound[a] : bound[a + len(x)]]
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        _, n = runs(key >> np.uint64(8 * WIDE))
        text = np.searchsorted(first, x, "right") - 1
        yield text, x - first[text], n, key & np.uint64((1 << 8 * WIDE) - 1)


def narrow(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(tokens, "<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE])


def widen(raw: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    out = np.zeros((len(raw) // WIDE, 8), np.uint8)
    out[:, :WIDE] = raw.reshape(-1, WIDE)
    return out.view("<u8").ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def among(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array that is not empty."""
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def needed(n: np.ndarray | int):
    """The smallest size of a set, and the smallest overlap with an equal-sized one, that can match size n."""
    return (NUM * n + DEN - 1) // DEN


def batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if isinstance(c, list) else pa.array(c) for c in cols], names=names.split())


#: The sets of a slice that stand first in it, packed by the hash of the set; k1 and k2 are empty in rows of lines
#: that an equal set of the same slice comes before.
CLASSES = "part int, k1 binary, k2 binary, doc binary, row binary, line binary, n binary, tokens binary"


def deal_lines(n_parts: int):
    """Packs the sets of each slice under their hash, and the places of its other lines of equal sets."""
    names = " ".join(x.split()[0] for x in CLASSES.split(", "))

    def work(batches):
        for b in batches:
            own, docs, rows = texts(b), b.column("doc_id").fill_null(NULL_ID).to_numpy(), b.column("row").to_numpy()
            for lo, hi in slices([len(t) for t in own]):
                got = [(a + x[0], *x[1:]) for a, z in slices([len(t) for t in own[lo:hi]], CACHED) for x in word_sets(own[lo + a : lo + z])]
                if not got:
                    continue
                text, line, n, token = (np.concatenate(x) for x in zip(*got))
                starts = np.cumsum(n) - n
                k1, k2 = (np.add.reduceat(mix(token, s), starts) for s in (1, 2))
                doc, row = docs[lo + text], rows[lo + text]
                order = np.lexsort((line, row, doc, k2, k1))
                new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
                again, at = order[~new], order[new]
                same = (doc[order][1:] == doc[order][:-1]) & (row[order][1:] == row[order][:-1]) & (line[order][1:] == line[order][:-1])
                again = again[~np.r_[False, same][~new]]  # a repeated row's lines have the places of the first one's
                if len(again):
                    none = [b""]
                    yield batch(names, np.array([row[again[0]] % n_parts], np.int32), none, none, [doc[again].tobytes()], [row[again].tobytes()], [line[again].astype(np.uint32).tobytes()], none, none)
                part = (mix(k1[at], 3) % np.uint64(n_parts)).astype(np.int32)
                at = at[np.argsort(part, kind="stable")]
                part.sort()
                raw = narrow(token[ranges(starts[at], n[at])])
                byte = np.r_[0, np.cumsum(n[at])]
                s, m = runs(part)
                cut = lambda c: [c[a : a + x].tobytes() for a, x in zip(s, m)]
                yield batch(names, part[s], *map(cut, (k1[at], k2[at], doc[at], row[at], line[at].astype(np.uint32), n[at].astype(np.uint32))), [raw[byte[a] : byte[a + x]].tobytes() for a, x in zip(s, m)])

    return work


#: Sets of a block: their numbers have 15 bits.
BLOCK = 8_000
SETS = "kind int, base long, doc binary, row binary, line binary, n binary, tokens binary"


def merge_lines(batches):
    """Of each word set: its first line and its words (kind 1, in the order of places); its other lines (kind 0)."""
    got, names = defaultdict(list), "kind base doc row line n tokens"
    put = lambda kind, base, *cols: batch(names, np.array([kind], np.int32), np.array([base]), *([c.tobytes()] for c in cols))
    none = np.zeros(0, np.uint8)
    for b in batches:
        for x in b.drop_columns(["part"]).to_pylist():
            if not x["k1"]:
                yield put(0, 0, *(np.frombuffer(x[c], np.uint8) for c in ("doc", "row", "line")), none, none)
                continue
            for c, v in x.items():
                got[c].append(v)
    if not got:
        return
    k1, k2, doc, row, line, n = (np.frombuffer(b"".join(got.pop(c)), t) for c, t in zip(("k1", "k2", "doc", "row", "line", "n"), ("u8", "u8", "i8", "i8", "u4", "u4")))
    raw, n = np.frombuffer(b"".join(got.pop("tokens")), np.uint8).reshape(-1, WIDE), n.astype(np.int64)
    at = np.cumsum(n) - n
    order = np.lexsort((line, row, doc, k2, k1))
    first = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
    same = np.r_[False, (doc[order][1:] == doc[order][:-1]) & (row[order][1:] == row[order][:-1]) & (line[order][1:] == line[order][:-1])]
    lead, again = order[first], order[~first & ~same]
    for a in range(0, len(again), 100_000):
        x = again[a : a + 100_000]
        yield put(0, 0, doc[x], row[x], line[x], none, none)
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    lead = lead[np.lexsort((line[lead], row[lead], doc[lead]))]
    for a in range(0, len(lead), BLOCK):
        x = lead[a : a + BLOCK]
        yield put(1, base + a, doc[x], row[x], line[x], n[x].astype(np.uint32), raw[ranges(at[x], n[x])])


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: as they are below 64, then eight steps to each doubling."""
    steep = 64 + (8 * np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    return np.minimum(np.where(n < 64, n, steep), 255).astype(np.uint8)


def slots(token: np.ndarray) -> np.ndarray:
    """The words' counters: bits of the hash that the bitmap (the lowest 7) has no use for."""
    return (token >> np.uint64(7) & np.uint64(COUNTERS - 1)).view(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """In about how many sets each word is (see coded), counted over all of them. The table is as large for any corpus."""
    wide = COUNTERS // CUTS

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for t in b.column("tokens"):
                own = slots(widen(np.frombuffer(t.as_buffer(), np.uint8))).astype(np.uint32)
                own.sort()
                at, n = runs(own)
                total[own[at]] += n.astype(np.uint32)
        z = zstandard.ZstdCompressor(level=1)
        for i in range(CUTS):
            yield batch("part n", np.array([i], np.int32), [z.compress(total[i * wide : (i + 1) * wide].tobytes())])

    def add(batches):
        total, z = {}, zstandard.ZstdDecompressor()
        for b in batches:
            for p, n in zip(b.column("part").to_pylist(), b.column("n").to_pylist()):
                total[p] = total.get(p, 0) + np.frombuffer(z.decompress(n), np.uint32).astype(np.uint64)
        for p, n in total.items():
            yield batch("part n", np.array([p], np.int32), [zstandard.compress(coded(n).tobytes(), 1)])

    out = np.zeros(COUNTERS, np.uint8)
    for r in sets.select("tokens").mapInArrow(tidy(count), "part int, n binary").repartition(CUTS, "part").mapInArrow(add, "part int, n binary").toLocalIterator():
        out[r.part * wide : (r.part + 1) * wide] = np.frombuffer(zstandard.decompress(r.n), np.uint8)
    return out


ENTRIES = {"token": "u1", "id": "i8", "doc": "i8", "n": "u4", "place": "u4", "low": "u8", "high": "u8"}
SMALL = {"id": "i8", "doc": "i8", "n": "u4", "place": "u4"}


def prefixes(held, n_parts: int, hot: int):
    """Each set under the rarest of its words, as many as a match must share one of, with a parity bitmap of its words.

    A word of `hot` sets or more stands with each later word of a prefix longer by one: two sets that match share
    two words at least, and the first two they share are so placed in both. Words that are certain to be in no other
    set take their place in the prefix, but are not sent.
    """
    crowded = int(coded(np.array([hot]))[0])

    def work(batches):
        table = held.value
        for b in batches:
            for base, doc, n, t in zip(*(b.column(c) for c in ("base", "doc", "n", "tokens"))):
                base, doc, n, token = base.as_py(), np.frombuffer(doc.as_buffer(), "i8"), np.frombuffer(n.as_buffer(), "u4").astype(np.int64), widen(np.frombuffer(t.as_buffer(), np.uint8))
                first = np.cumsum(n) - n
                bit = np.uint64(1) << (token & np.uint64(63))
                upper = bit * (token >> np.uint64(6) & np.uint64(1))
                low, high = (np.bitwise_xor.reduceat(x, first) for x in (upper, bit ^ upper))
                every = np.arange(len(n))
                order = np.repeat(every << 49, n)
                order |= table[slots(token)].astype(np.int64) << 41
                order |= np.arange(len(token))  # a set's words ascend already
                order = order.view(np.uint64)
                order.sort()
                reach = np.where(n >= LEAST, n - needed(n) + 1, 0)
                span = reach + (reach > 0)  # with the one word that only stands second
                at = ranges(first, span)
                own = np.repeat(every, span)
                place = at - first[own]
                order = order.view(np.int64)[at]
                token, count = token[order & ((1 << 41) - 1)], order >> 41 & 255
                keep = place < reach[own]
                keep &= count > 1  # a word of one set alone brings none together
                at = np.flatnonzero(keep & (count < crowded))
                key = mix(token[at], 4)
                if len(full := np.flatnonzero(keep & (count >= crowded))):
                    further = reach[own[full]] - place[full]  # words of the longer prefix behind this one
                    second = ranges(full + 1, further)
                    full = np.repeat(full, further)
                    at, key = np.r_[at, full], np.r_[key, mix(mix(token[full], 8) ^ token[second], 9)]
                    order = np.argsort(at, kind="stable")
                    at, key = at[order], key[order]
                own, place = own[at], place[at]
                part = (key % np.uint64(n_parts)).astype(np.int32)
                yield squeezed(packed(part, token=narrow(key >> np.uint64(16)), id=base + own, doc=doc[own], n=n[own].astype(np.uint32), place=place.astype(np.uint32), low=low[own], high=high[own]), **SMALL)

    return work


POSTINGS = {"key": "u8", "id": "i8", "doc": "i8", "n": "u4", "place": "u4", "low": "u8", "high": "u8"}
#: Entries of a row of the postings, which ends where a token ends.
ROW = 1 << 17
SIZE = np.uint64(20)
SIZES = np.uint64((1 << 20) - 1)


def postings(batches):
    """A partition's prefix entries by token and size of their set, whole tokens in a row. The key is 44 bits of the
    token's hash and the size, up to a limit; tokens that share a key only bring more sets together."""
    got = unpacked((unsqueezed(b, **SMALL) for b in batches), **ENTRIES)
    key = widen(got.pop("token")) << SIZE | np.minimum(got["n"], SIZES).astype(np.uint64)
    if not len(key):
        return
    order = np.argsort(key)
    got = {"key": key[order]} | {c: got[c][order] for c in got}
    start, size = runs(got["key"] >> SIZE)
    ends, a = start + size, 0
    while a < len(key):
        i = np.searchsorted(ends, min(a + ROW, len(key)))
        yield squeezed(packed(np.zeros(ends[i] - a, np.int32), **{c: v[a : ends[i]] for c, v in got.items()}), key="u8", **SMALL)
        a = ends[i]


#: A set looks at so many neighbours by size first; where one of them may match it, others wait for a later round.
NEAR = 4
#: Pairs that are looked at together.
PAIRS = 1 << 18


def candidates(least: int, most: int, first: bool, only=None):
    """(x, y, more): for each set, sets under one of its tokens that size, place and bitmap let match it, not later ones.

    Within a token sets are sorted by size, so a set meets those of a fitting size only. The first round takes about
    `most` partners, of the nearest neighbours of each set, or of all where these give none; later rounds take the
    `least`-th to before the `most`-th partner of each set (of those in only). more tells that a set may have others.
    """

    def find(got):
        key, own, n, place, low, doc = got["key"], got["id"], got["n"].astype(np.int64), got["place"].astype(np.int64), got["low"], got["doc"]
        high = got["high"]
        group, size = key >> SIZE, (key & SIZES).astype(np.int64)

        def fitting(x, y):
            a, b = n[x], n[y]
            fits = (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)) & ((NUM + DEN) * np.minimum(a - place[x], b - place[y]) >= NUM * (a + b))
            x, y = x[fits], y[fits]
            differ = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
            fits = (NUM + DEN) * differ <= (DEN - NUM) * (n[x] + n[y])
            return x[fits], y[fits]

        def before(y, x):  # which of two sets of one doc_id is earlier is seen when they are compared
            return (doc[y] < doc[x]) | (doc[y] == doc[x]) & (own[y] != own[x])

        def partners(at, start, end):
            """(x, y) with x of at and y from its start to before its end, in pieces; a crowd of one x in several."""
            bound, i = np.cumsum(end - start), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(bound, (bound[i - 1] if i else 0) + PAIRS, "right")))
                if j == i + 1:
                    for a in range(int(start[i]), int(end[i]), PAIRS):
                        y = np.arange(a, min(a + PAIRS, int(end[i])))
                        yield np.full(len(y), at[i]), y
                else:
                    yield np.repeat(at[i:j], end[i:j] - start[i:j]), ranges(start[i:j], end[i:j] - start[i:j])
                i = j

        give = lambda x, y, more: batch("x y more", own[x], own[y], more)
        every, had = np.arange(len(own)), np.zeros(len(own), np.int64)
        at = every if first or only is None else np.flatnonzero(among(own, only.value))
        start = np.searchsorted(key, group[at] << SIZE | needed(size[at]).astype(np.uint64))
        end = np.searchsorted(key, group[at] << SIZE | np.minimum(DEN * size[at] // NUM, int(SIZES)).astype(np.uint64), "right")
        if not first:
            several = end - start > 1
            for x, y in partners(at[several], start[several], end[several]):
                ok = before(y, x)
                x, y = fitting(x[ok], y[ok])
                if len(x):
                    s, m = runs(x)
                    rank = had[x] + np.arange(len(x)) - np.repeat(s, m)
                    had[x[s]] += m
                    ok = (rank >= least) & (rank < most)
                    yield give(x[ok], y[ok], rank[ok] == most - 1)
            return

        def wanted(x, y):
            """Those of the partners that x has not had `most` of by now."""
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            s, m = runs(x)
            ok = had[x] + np.arange(len(x)) - np.repeat(s, m) < most
            had[x[s]] += m
            return give(x[ok], y[ok], np.ones(np.count_nonzero(ok), bool))

        def offered(x, y):
            x, y = fitting(x, y)
            x, y = np.r_[x, y], np.r_[y, x]
            ok = before(y, x)
            return wanted(x[ok], y[ok])

        at = every
        for gap in range(1, NEAR + 1):
            at = at[at - start[at] >= gap]
            yield offered(at, at - gap)
        # where most sets of a token are still without a candidate, all pairs are looked at once, not from either side
        left = had == 0
        s, m = runs(group)
        both = np.repeat(np.add.reduceat(every - start, s) <= np.add.reduceat((end - start) * left, s), m)
        at = every[both & (every > start)]
        for x, y in partners(at, start[at], at):
            ok = left[x] | left[y]
            yield offered(x[ok], y[ok])
        at = every[~both & left]
        for x, y in partners(at, start[at], end[at]):
            ok = had[x] < most
            x, y = fitting(x[ok], y[ok])
            ok = before(y, x)
            yield wanted(x[ok], y[ok])

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from (x for x in find(unpacked([unsqueezed(b.slice(i, 1), key="u8", **SMALL)], **POSTINGS)) if x.num_rows)

    return work


WANTED = "part int, base long, doc binary, row binary, line binary, n binary, tokens binary, id binary, to binary"
SENT = "part int, to binary, own binary, doc binary, row binary, line binary, n binary, tokens binary"


def want(batches):
    """(id, to) as packed rows where the id's set is."""
    for b in batches:
        own, to = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "to"))
        yield packed((own >> np.int64(40)).astype(np.int32), id=own, to=to)


def sent(block: dict, own: np.ndarray, to: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    """The words of the block's wanted sets (own ascending), packed by where they are compared."""
    names = " ".join(x.split()[0] for x in SENT.split(", "))
    doc, row, line, n = (np.frombuffer(block[c], t) for c, t in (("doc", "i8"), ("row", "i8"), ("line", "u4"), ("n", "u4")))
    size, raw = n.astype(np.int64), np.frombuffer(block["tokens"], np.uint8).reshape(-1, WIDE)
    at = np.cumsum(size) - size
    lo, hi = np.searchsorted(own, block["base"]), np.searchsorted(own, block["base"] + len(n))
    for a in range(lo, hi, 50_000):
        i, t = own[a : min(hi, a + 50_000)] - block["base"], to[a : min(hi, a + 50_000)]
        part = (mix(t, 6) % np.uint64(n_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        i, t, part = i[order], t[order], part[order]
        s, m = runs(part)
        cols = (t, i + block["base"], doc[i], row[i], line[i], n[i])
        words = [raw[ranges(at[i[u : u + v]], size[i[u : u + v]])].tobytes() for u, v in zip(s, m)]
        yield batch(names, part[s], *([c[u : u + v].tobytes() for u, v in zip(s, m)] for c in cols), words)


def send(n_parts: int):
    """The wanted sets' words, where blocks and wanted ids have been brought together."""

    def work(batches):
        wanted, blocks = [], []
        for b in batches:
            for x in b.to_pylist():
                (wanted if x["base"] is None else blocks).append(x)
        if not wanted:
            return
        own, to = (np.frombuffer(b"".join(x[c] for x in wanted), "i8") for c in ("id", "to"))
        order = np.argsort(own, kind="stable")
        for x in blocks:
            yield from sent(x, own[order], to[order], n_parts)

    return work


def send_few(n_parts: int, held):
    """The same where the wanted ids are few enough for every task to have them."""

    def work(batches):
        own, to = held.value
        for b in batches:
            for i in range(b.num_rows):
                yield from sent(b.slice(i, 1).to_pylist()[0], own, to, n_parts)

    return work


def verify(batches):
    """(x, doc, row, line) of the sets whose words match those of an earlier candidate sent to the same place."""
    got = defaultdict(list)
    for b in batches:
        for c in ("to", "own", "doc", "row", "line", "n", "tokens"):
            got[c] += b.column(c).to_pylist()
    if not got:
        return
    to, own, doc, row, line, n = (np.frombuffer(b"".join(got.pop(c)), t) for c, t in (("to", "i8"), ("own", "i8"), ("doc", "i8"), ("row", "i8"), ("line", "u4"), ("n", "u4")))
    token, n = widen(b"".join(got.pop("tokens"))), n.astype(np.int64)
    at = np.cumsum(n) - n
    order = np.lexsort((own != to, to))  # the set itself stands first
    s, m = runs(to[order])
    x, y = np.repeat(order[s], m), order
    place = lambda i: (doc[i], row[i], line[i])
    (a, b, c), (d, e, f) = place(y), place(x)
    before = (a < d) | (a == d) & ((b < e) | (b == e) & (c < f))
    x, y = x[before], y[before]
    found = []
    bound, i = np.cumsum(n[x] + n[y]), 0
    while i < len(x):  # so many pairs together that their words fill some megabytes
        j = min(max(i + 1, int(np.searchsorted(bound, (bound[i - 1] if i else 0) + (1 << 20), "right"))), i + 60_000)
        u, v = x[i:j], y[i:j]
        pair = np.arange(len(u), dtype=np.uint64) << np.uint64(8 * WIDE)
        key = np.r_[np.repeat(pair, n[u]) | token[ranges(at[u], n[u])], np.repeat(pair, n[v]) | token[ranges(at[v], n[v])]]
        key.sort()
        both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(8 * WIDE)).astype(np.int64), minlength=len(u))
        found.append(u[both * DEN >= NUM * (n[u] + n[v] - both)])
        i = j
    if found and len(found := np.unique(np.concatenate(found))):
        yield batch("x doc row line", to[found], doc[found], row[found], line[found].astype(np.int64))


#: Candidates of a set under each of its tokens in the first round, of which one is compared, and in the second, which
#: compares all; each further round takes GROWTH times as many.
FIRST_ROUND, SECOND_ROUND, GROWTH = 1, 12, 256
#: The second round takes more than SECOND_ROUND, up to GROWTH times as many, where few sets are left: as many for each
#: as make up so many times the pairs of the first round. A round reads all postings and all lines.
SHARE = 16


def second(pairs: int, left: int) -> int:
    """How many candidates under each token the second round takes."""
    return min(SECOND_ROUND * GROWTH, max(SECOND_ROUND, SHARE * pairs // left))


#: Up to so many ids (8 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def ids(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.select(*columns).toArrow()
    return [got.column(c).to_numpy() for c in columns]


def near_matches(sets: DataFrame, n: int) -> DataFrame:
    """(doc, row, line) of the sets that match an earlier one. Sets without a match so far come into the next round
    while they may have more candidates, so the result is that of all pairs."""
    context = sets.sparkSession.sparkContext
    held = context.broadcast(rarity(sets))
    dealt = sets.mapInArrow(tidy(prefixes(held, n, HOT)), packed_schema(*ENTRIES)).repartition(n, "part")
    dealt = stored(dealt.mapInArrow(tidy(postings), packed_schema(*POSTINGS)), "postings")
    least, most, first, found, only = 0, FIRST_ROUND, True, None, None
    while True:
        pairs = dealt.mapInArrow(tidy(candidates(least, most, first, only)), "x long, y long, more boolean")
        if not first and only is None:
            pairs = pairs.join(found.select("x"), "x", "left_anti")
        if first:  # most sets with a candidate match it: one is enough to begin with, any others come next
            pairs = pairs.groupBy("x").agg(F.min("y").alias("y"), (F.max("more") | (F.min("y") < F.max("y"))).alias("more"))
        else:
            pairs = pairs.groupBy("x", "y").agg(F.max("more").alias("more"))
        pairs = stored(pairs, "pairs")
        to = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("x").alias("to")), F.struct(F.col("y").alias("id"), F.col("x").alias("to"))))
        to = pairs.select(to.alias("w")).select("w.*").distinct()
        if (met := pairs.count()) <= BROADCAST_IDS // 4:  # an id of its own and one of a partner each, 16 bytes a piece
            own, at = ids(to, "id", "to")
            order = np.argsort(own, kind="stable")
            few = context.broadcast((own[order], at[order]))
            words = sets.mapInArrow(tidy(send_few(n, few)), SENT)
        else:
            both = sets.withColumn("part", F.shiftright("base", 40).cast("int")).unionByName(to.mapInArrow(want, "part int, id binary, to binary"), allowMissingColumns=True)
            words = both.select(*(x.split()[0] for x in WANTED.split(", "))).repartition(n, "part").mapInArrow(tidy(send(n)), SENT)
        now = stored(words.repartition(n, "part").mapInArrow(tidy(verify), "x long, doc long, row long, line long"), "matches")
        found = now if found is None else found.unionByName(now)
        left = pairs.where("more").join(found.select("x"), "x", "left_anti").select("x").distinct()
        left = stored(left, "left")
        if not (count := left.count()):
            discard(dealt)
            return found.select("doc", "row", "line")
        only = context.broadcast(np.sort(ids(left, "x")[0])) if count <= BROADCAST_IDS else None
        # what the first round gave may stand anywhere among all partners, so the second begins with the first of them
        least, most, first = (0, second(met, count), False) if first else (most, GROWTH * most, False)


def later_matches(docs: DataFrame) -> DataFrame:
    """(doc, row, lines) of the rows of docs (row, doc_id, text) that hold lines with an earlier match, lines ascending.

    A line's words are its runs of letters, digits and characters beyond ASCII, A-Z lower-cased; two lines match at
    a Jaccard similarity of 0.8 of their word sets. Words are compared by 48 bits of a hash, so two words count as
    the same with a chance of 2**-48; sets count as equal by 128 bits. Earlier is by doc_id (nulls first, as the
    smallest long), row and place in the text. Rows of equal doc_id and row count as one. Lines of equal sets are
    merged before any join. Lines without words match nothing.
    """
    n = parts(docs, 64 << 20)
    dealt = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(deal_lines(n)), CLASSES)
    every = stored(dealt.repartition(n, "part").mapInArrow(tidy(merge_lines), SETS), "lines")
    near = near_matches(every.where("kind = 1").drop("kind"), n)

    def spread(batches):
        for b in batches:
            for d, r, k in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "line"))):
                yield batch("doc row line", np.frombuffer(d, np.int64), np.frombuffer(r, np.int64), np.frombuffer(k, np.uint32).astype(np.int64))

    same = every.where("kind = 0").select("doc", "row", "line").mapInArrow(spread, "doc long, row long, line long")
    out = stored(same.unionByName(near).groupBy("doc", "row").agg(F.array_sort(F.collect_set("line")).alias("lines")), "removed")
    discard(every)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text cut down to the lines without an earlier match, and n_lines, n_removed (long) besides.

    Null texts stay null and have no lines; a text whose lines all go becomes empty; the line ends of what stays
    are kept as \\n. Of rows of equal doc_id and text one (any) keeps its first lines, the others are copies of it.
    Rows are known by doc_id and a 64-bit hash of the text, so they may be computed anew in another order. Other
    columns stay as they are; columns named n_lines or n_removed are replaced, names beginning with __line_ are
    not allowed.
    """
    rows = docs.drop("n_lines", "n_removed")
    key = F.xxhash64("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    gone = later_matches(rows.select(key[0].alias("row"), "doc_id", "text"))
    gone = gone.select(F.col("row").alias("__line_row"), F.col("doc").alias("__line_doc"), F.col("lines").alias("__line_gone"))
    rows = rows.withColumns({"__line_row": key[0], "__line_doc": key[1]})
    copy = F.row_number().over(Window.partitionBy("__line_row", "__line_doc").orderBy("__line_row"))
    joined = rows.withColumn("__line_copy", copy).join(gone, ["__line_row", "__line_doc"], "left").drop("__line_row", "__line_doc")

    def cut(batches):
        for b in batches:
            out, n, m = [], [], []
            for t, copy, gone in zip(*(x.to_pylist() for x in (b.column("text").cast(pa.binary()), b.column("__line_copy"), b.column("__line_gone")))):
                own = [] if t is None else t.split(b"\n")
                drop = {i for i, x in enumerate(own) if words(x)} if copy > 1 else set(gone or ())
                n.append(len(own))
                m.append(len(drop))
                out.append(b"\n".join([x for i, x in enumerate(own) if i not in drop]) if drop else t)
            b = b.drop_columns(["__line_copy", "__line_gone"])
            b = b.set_column(b.schema.names.index("text"), "text", pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[*b.schema.names, "n_lines", "n_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("n_lines", "n_removed").schema)
    return joined.mapInArrow(tidy(cut), kinds + ", n_lines long, n_removed long")


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    own = deduplicated(docs.select("doc_id", "text"))
    return own.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
