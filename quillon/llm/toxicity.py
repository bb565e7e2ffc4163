"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared by window."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, tidy
from .decontaminate import words

#: At most so many labelled documents of each class are sampled for the dictionaries and the calibration, by hash.
SAMPLE = {1: 1500, 0: 6000}
#: And whole texts of each class in that order, until they have so many bytes.
SAMPLE_BYTES = {1: 24 << 20, 0: 48 << 20}
WINDOW = 12
#: Ends every window and both dictionaries, so that each window has a match and lengths differ by content alone.
END = bytes(range(1, 32))
GAP = b"\x7f"
#: Word beginnings of so many bytes, with the space before them, are candidates. Each length has its own pair of
#: dictionaries, whose shortest match is that length: a match is a whole gram, never a part of one.
GRAMS = range(5, 8)
LEAST_Z, LEAST_RATIO, LEAST_DOCS = 5.0, 5.0, 3
#: Shingles of a text from which on a sixteenth of them tells copies among the sampled documents.
SHINGLES = 128
#: Added to the number of words and of windows where shares are taken, so that a short text's count for less.
FEW_WORDS, FEW_WINDOWS = 12, 2


@dataclass
class Model:
    """Dictionaries of toxic and of ordinary text for each length in GRAMS, and the calibration's weights."""

    contents: list[tuple[bytes, bytes]]
    weights: list[float]

    def compressors(self):
        return [tuple(_compressor(c, n) for c in pair) for n, pair in zip(GRAMS, self.contents)]


def _compressor(content: bytes, least: int):
    data = zstandard.ZstdCompressionDict(content + END, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # literals stay as they are (fast strategy with a target length), so a length tells of matches only
    own = zstandard.ZstdCompressionParameters.from_level(1, min_match=least, strategy=zstandard.STRATEGY_FAST, target_length=1, window_log=17, hash_log=14, write_content_size=False, write_checksum=False, write_dict_id=False)
    data.precompute_compress(compression_params=own)
    return zstandard.ZstdCompressor(compression_params=own, dict_data=data)


def windows(text: bytes) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " + END for i in range(0, len(w), WINDOW)]


def lengths(compressor, items: list[bytes]) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(items, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def features(compressors, documents: list[bytes]) -> np.ndarray:
    """For each document the shares of its windows that some toxic and some ordinary dictionary saves bytes on.

    They do not grow with a text's length.
    """
    own = [windows(t) for t in documents]
    flat = [w for x in own for w in x]
    out = np.zeros((len(documents), 2))
    if not flat:
        return out
    save, at = np.stack([lengths(o, flat) - lengths(t, flat) for t, o in compressors]), 0
    toxic, ordinary = (save >= 1).any(0), (save <= -1).any(0)
    for i, x in enumerate(own):
        out[i] = [y[at : at + len(x)].sum() / (len(x) + FEW_WINDOWS) for y in (toxic, ordinary)]
        at += len(x)
    return out


def distinct_documents(documents: list[bytes], most: int) -> list[bytes]:
    """Those that share under half of their five-word shingles with the ones before; of texts with SHINGLES or more,
    the one shingle in 16 that its hash names stands for them."""
    seen: set[int] = set()
    out = []
    for t in documents:
        w = words(t)
        own = {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(own) >= SHINGLES:
            own = {x for x in own if x & 15 == 0} or own
        if w and 2 * len(own & seen) < len(own):
            out.append(t)
        seen |= own
        if len(out) == most:
            break
    return out


class Rates:
    """Of each gram over documents: sum and sum of squares of its share of a document's words, and the documents."""

    def __init__(self, documents: list[bytes]):
        self.n, self.sum, self.squares, self.documents = len(documents), Counter(), Counter(), Counter()
        for t in documents:
            w = words(t)
            own = Counter()
            for x, k in Counter(b" " + x + b" " for x in w).items():
                for n in GRAMS:
                    if len(x) >= n:
                        own[x[:n]] += k
            for g, k in own.items():
                share = k / (len(w) + FEW_WORDS)
                self.sum[g] += share
                self.squares[g] += share * share
                self.documents[g] += 1


def contrast(of: Rates, against: Rates) -> list[bytes]:
    """All grams that mark documents of one class, by how often they occur in them."""
    n, m = of.n, against.n

    def z(g):
        p = (of.sum[g] + against.sum[g]) / (n + m)
        v = (of.squares[g] + against.squares[g]) / (n + m) - p * p
        return (of.sum[g] / n - against.sum[g] / m) / math.sqrt(v * (1 / n + 1 / m) + 1e-12)

    return sorted(g for g, k in of.documents.items() if k >= LEAST_DOCS and of.sum[g] / n > LEAST_RATIO * against.sum[g] / m and z(g) > LEAST_Z)


def content(marks: list[bytes], n: int) -> bytes:
    return GAP + GAP.join(g for g in marks if len(g) == n) + GAP


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries and calibration from the sampled documents. Without labels of both kinds every score is low."""
    toxic, ordinary = distinct_documents(toxic, SAMPLE[1]), distinct_documents(ordinary, SAMPLE[0])
    if not toxic or not ordinary:
        return Model([(GAP, GAP)] * len(GRAMS), [-3.0, 0.0, 0.0])
    a, b = Rates(toxic), Rates(ordinary)
    marks, plain = contrast(a, b), contrast(b, a)
    model = Model([(content(marks, n), content(plain, n)) for n in GRAMS], [])
    both = model.compressors()
    x = np.vstack([features(both, toxic), features(both, ordinary)])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    x1 = np.c_[np.ones(len(x)), x]
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x1.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (balance * p * (1 - p))[:, None]).T @ x1 + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x1.T @ (balance * (y - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.contents, w.tolist())


def learn(docs: DataFrame, labels: DataFrame, bound: dict[int, int] = SAMPLE, size: dict[int, int] = SAMPLE_BYTES) -> Model:
    """A model from a bounded sample of whole labelled texts that are not held out (see held_out)."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    own = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("t"))
    before = Window.orderBy("h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    took = []
    for k in (1, 0):
        ids = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound[k]).select("doc_id")
        rows = own.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "t").limit(2 * bound[k])
        rows = rows.withColumn("bytes", F.coalesce(F.sum(F.octet_length("t")).over(before), F.lit(0))).where(F.col("bytes") < size[k]).orderBy("h", "doc_id", "t").select("t")
        took.append([bytes(r.t) for r in rows.toLocalIterator()])
    return fit(*took)


def held_out(column: str):
    """True for rows that are never learnt from: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs (doc_id, text), from the text alone.

    Null and empty texts get the score of a text without toxic windows. Repeated rows and null doc_ids keep a row
    each; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        both = model.compressors()
        for b in batches:
            own = texts(b)
            for at in range(0, len(own), 200):
                part = own[at : at + 200]
                x = np.c_[np.ones(len(part)), features(both, part)] @ np.array(model.weights)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 200), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), f"doc_id {kind}, score double")


def op9_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    found = scores(docs, learn(docs, labels))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score at the threshold or above; all columns stay as they are."""
    model = learn(docs, labels)

    def work(batches):
        both = model.compressors()
        for b in batches:
            own = texts(b)
            for at in range(0, len(own), 200):
                part = own[at : at + 200]
                x = np.c_[np.ones(len(part)), features(both, part)] @ np.array(model.weights)
                yield b.slice(at, 200).filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < threshold))

    return docs.mapInArrow(tidy(work), docs.schema)
