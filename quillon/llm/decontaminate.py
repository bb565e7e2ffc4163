"""Benchmark decontamination by a positional inverted index that is spread over the executors by document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts, without

#: Bytes of benchmark text that one pass over the index answers; larger benchmarks take further passes. Its windows
#: take about 165 times as many bytes of a worker's memory, and of the driver's.
BLOCK_BYTES = 1 << 20
#: Lower-cases A-Z and turns what is in no word into spaces.
WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item_id as text or None, words) of the items that have words, in blocks of about `most` bytes."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        if w := words(bytes(row.t or b"")):
            if block and size + len(row.t) > most:
                yield block
                block, size = [], 0
            block.append((row.i, w))
            size += len(row.t)
    if block:
        yield block


class Phrases:
    """A block's windows over its own term numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, w in items:
            ids = [self.terms.setdefault(x, len(self.terms)) for x in w]
            for i in range(max(1, len(ids) - width + 1)):
                found[tuple(ids[i : i + width])] |= {item} - {None}
        self.windows = [(w, sorted(found[w])) for w in found]

    def by_rarest(self, counts: np.ndarray) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
        """For each term: (window, (term, offset) from the rarest on) of the windows whose rarest term it is."""
        out = defaultdict(list)
        for k, (w, _) in enumerate(self.windows):
            order = sorted(range(len(w)), key=lambda o: (counts[w[o]], o))
            if counts[w[order[0]]]:  # a term that never occurs: nor does the window
                out[w[order[0]]].append((k, [(w[o], o) for o in order]))
        return dict(out)


def postings(docs: DataFrame, terms: dict[bytes, int], kind: str) -> DataFrame:
    """The index for the terms: a row for each of (row, key, text), with its terms, sorted, and their positions."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches):
        number = held.value
        for b in batches:
            out = []
            for t in texts(b):
                w = words(t)
                ids = np.array([number.get(x, -1) for x in w], np.int32)
                at = np.flatnonzero(ids >= 0)
                own = ids[at]
                order = np.argsort(own, kind="stable")
                own, at = own[order], at[order].astype(np.uint32)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                out.append((len(w), own[first].tobytes(), np.r_[first[1:], len(own)].astype(np.uint32).tobytes() if len(own) else b"", at.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("key"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary())))],
                names=["row", "key", "n_words", "terms", "ends", "places"],
            )

    return docs.mapInArrow(work, f"row long, key {kind}, n_words long, terms binary, ends binary, places binary")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term over all of the index; the vector's length is bounded by the block."""
    def work(batches):
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for t, e in zip(b.column("terms").to_pylist(), b.column("ends").to_pylist()):
                total[np.frombuffer(t, np.int32)] += np.diff(np.frombuffer(e, np.uint32).astype(np.int64), prepend=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    counts = np.zeros(n_terms, np.int64)
    rows = index.select("terms", "ends").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in rows.toLocalIterator():
        counts[r.term] = r.n
    return counts


def matches(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, rarest: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(window, starts) of the windows that occur in one document, by intersecting offset-adjusted position lists."""
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    where = {int(t): (int(a), int(b)) for t, a, b in zip(terms, starts, ends)}
    for t in where.keys() & rarest.keys():
        for k, steps in rarest[t]:
            found = None
            for term, offset in steps:
                if term not in where:
                    found = None
                    break
                a, b = where[term]
                at = places[a:b].astype(np.int64) - offset
                if found is None:
                    found = at[at >= 0]
                else:
                    found = found[at[np.minimum(np.searchsorted(at, found), len(at) - 1)] == found]
                if not len(found):
                    break
            if found is not None and len(found):
                yield k, found


def proximity(terms: np.ndarray, ends: np.ndarray, places: np.ndarray, window: tuple[int, ...], slack: int) -> list[tuple[int, int]]:
    """(start, end) where the window's terms occur in order with at most `slack` further words between them in all."""
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    where = {int(t): places[int(a) : int(b)] for t, a, b in zip(terms, starts, ends)}
    if any(t not in where for t in window):
        return []
    out = []
    for p in where[window[0]]:
        at = int(p)
        for t in window[1:]:
            i = int(np.searchsorted(where[t], at + 1))
            if i == len(where[t]):
                at = -1
                break
            at = int(where[t][i])
        if at >= 0 and at - int(p) - len(window) + 1 <= slack:
            out.append((int(p), at + 1))
    return out


def cover(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (start, end) that cover the same positions."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], 1)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slack: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, item_ids (sorted array of text) and spans (array of word ranges) for every row of docs.

    A window is `width` consecutive words of an item, or a whole shorter item; each word inside an occurrence is
    hit. With `slack`, windows also match with so many further words between theirs. The postings of all documents
    are stored for each block of the benchmark, counted over the whole corpus, and searched from the rarest term of
    each window. Blocks bound what is broadcast: larger benchmarks take more passes. Null and empty texts have no
    words and match nothing, items without an id hit words but are not named, repeated documents give a row each,
    repeated items count once, and an empty benchmark hits nothing. Other columns are not read.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), "text").withColumn("row", F.monotonically_increasing_id())
    every = []
    for block in blocks(benchmark):
        phrases = Phrases(block, width)
        index = stored(postings(rows, phrases.terms, kind), "postings")
        held = sc.broadcast((phrases.by_rarest(term_counts(index, len(phrases.terms))), phrases.windows))
        every.append(index.mapInArrow(search(held, slack), f"row long, key {kind}, n_words long, {FOUND}"))
    if not every:
        every = [postings(rows, {}, kind).select("row", "key", "n_words", F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<a: long, b: long>>").alias("spans"))]
    found = every[0]
    for x in every[1:]:
        found = found.unionByName(x)
    if len(every) > 1:
        found = found.groupBy("row").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))

    def total(batches):
        for b in batches:
            spans = [cover(np.array([(x["a"], x["b"]) for x in s], np.int64).reshape(-1, 2)) for s in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("n_words"), pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()), b.column("item_ids"), pa.array([[{"a": int(x), "b": int(y)} for x, y in s] for s in spans], SPANS)],
                names=[key, "n_words", "n_hit", "item_ids", "spans"],
            )

    return found.select("key", "n_words", "item_ids", "spans").mapInArrow(total, f"{key} {kind}, n_words long, n_hit long, {FOUND}")


FOUND = "item_ids array<string>, spans array<struct<a: long, b: long>>"
SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def search(held, slack: int | None):
    def work(batches):
        rarest, windows = held.value
        for b in batches:
            items, spans = [], []
            for t, e, p in zip(*(b.column(c).to_pylist() for c in ("terms", "ends", "places"))):
                t, e, p = np.frombuffer(t, np.int32), np.frombuffer(e, np.uint32), np.frombuffer(p, np.uint32)
                own, at = set(), []
                for k, starts in matches(t, e, p, rarest):
                    own.update(windows[k][1])
                    at += [(int(s), int(s) + len(windows[k][0])) for s in starts]
                if slack is not None:
                    for k in {k for x in set(t.tolist()) & rarest.keys() for k, _ in rarest[x]}:
                        for s, end in proximity(t, e, p, windows[k][0], slack):
                            own.update(windows[k][1])
                            at.append((s, end))
                items.append(sorted(own))
                spans.append([{"a": int(x), "b": int(y)} for x, y in cover(np.array(at, np.int64).reshape(-1, 2))])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), b.column("n_words"), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS)], names=["row", "key", "n_words", "item_ids", "spans"])

    return work


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs. Rows with a null doc_id stay if clean.

    Rows are known by a 64-bit hash of their text, on which alone the decision rests, so they may be computed anew
    in another order. A column named __text_hash is not allowed.
    """
    ids = docs.withColumn("__text_hash", F.xxhash64("text"))
    return without(ids, contamination(ids, benchmark, width, key="__text_hash").where("n_hit > 0"), "__text_hash").select(*docs.columns)
