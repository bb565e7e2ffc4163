"""Semantic keys: sliding windows of chunks, embeddings, sign projections, and scans over binary keys."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..functions import hypervectors as hv
from ..functions.codec import tokenize
from ..functions.scores import angular


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Sums of +-1 vectors out of each word's SHA-256, normalised: deterministic and without a model."""

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hash-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                raw = hashlib.sha256(w.encode()).digest()
                while 8 * len(raw) < self.dim:
                    raw += hashlib.sha256(raw[-32:]).digest()
                out[i] += 2.0 * np.unpackbits(np.frombuffer(raw[: self.dim // 8], np.uint8), bitorder="little") - 1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


class HttpEmbedder:
    """An embedding service; any failure is a SemanticError, on which callers fall back to lexical ranking."""

    def __init__(self, endpoint: str, model: str, dim: int = C.SEM_DIM, batch: int = 128, timeout: float = 600):
        self.endpoint, self.name, self.dim, self.batch, self.timeout = endpoint, model, dim, batch, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        import urllib.request

        out = []
        try:
            for a in range(0, len(texts), self.batch):
                body = json.dumps({"model": self.name, "input": texts[a : a + self.batch]}).encode()
                with urllib.request.urlopen(urllib.request.Request(f"{self.endpoint}/api/embed", body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                    out += json.load(r)["embeddings"]
            x = np.array(out, np.float64).reshape(len(texts), self.dim)
        except Exception as e:
            raise C.SemanticError(f"no embeddings: {e}") from e
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def projection(bits: int, dim: int) -> np.ndarray:
    """The +-1 matrix (bits, dim) out of the SEMR streams, row by row."""
    n = -(-bits * dim // C.DIM)
    raw = np.frombuffer(b"".join(hv.stream(b"SEMR", i) for i in range(n)), np.uint8)
    return (2.0 * np.unpackbits(raw, bitorder="little")[: bits * dim] - 1).reshape(bits, dim)


def windows(docs: DataFrame, k: int = C.CHUNK, width: int = C.SEM_WINDOW, stride: int = C.SEM_STRIDE) -> DataFrame:
    """(doc_id, win_start, win_len, text): runs of up to `width` chunks every `stride`, each chunk in at least one."""
    own = docs.select("doc_id", tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    n = F.ceil(F.size("t") / k).cast("int")
    own = own.select("doc_id", "t", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n - stride, F.lit(0)), F.lit(stride))).alias("win_start"))
    return own.select("doc_id", F.col("win_start").cast("long").alias("win_start"), F.least(F.lit(width), F.col("n") - F.col("win_start")).cast("long").alias("win_len"), F.array_join(F.slice("t", F.col("win_start") * k + 1, F.lit(width * k)), "").alias("text"))


def embedded(wins: DataFrame, embedder: Embedder) -> DataFrame:
    def work(batches):
        for pdf in batches:
            yield pdf.assign(emb=list(embedder.embed(pdf.text.tolist())))

    return wins.mapInPandas(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wins.schema) + ", emb array<double>")


def centroid(rows: DataFrame, emb: str = "emb") -> list[float]:
    """The mean embedding: a number for each dimension."""
    got = rows.select(F.posexplode(emb).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    return [r.m for r in got]


def keys(rows: DataFrame, mu: list[float], bits: int = C.SEM_BITS, emb: str = "emb") -> DataFrame:
    """rows with key: bit j tells whether the centred embedding lies on the positive side of projection j."""
    m, r = np.array(mu), projection(bits, len(mu))

    @F.pandas_udf("binary")
    def key(x: pd.Series) -> pd.Series:
        side = (np.stack(x.to_numpy()).astype(np.float64) - m) @ r.T > 0
        return pd.Series([v.tobytes() for v in hv.pack(side)])

    return rows.withColumn("key", key(emb))


def scan(keyed: DataFrame, queries: list[tuple[int, bytes]], bits: int, ids: list[str], per_batch: int | None = None) -> DataFrame:
    """(qid, ids..., ham, sem) of every keyed row for each query, or of the per_batch nearest in each batch."""
    rows = np.frombuffer(b"".join(v for _, v in queries), np.uint8).reshape(len(queries), -1)
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}

    def work(batches):
        for b in batches:
            own = np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            if not b.num_rows:
                continue
            for (qid, _), q in zip(queries, rows):
                d = hv.hamming_rows(own, q)
                at = np.argsort(d, kind="stable")[:per_batch] if per_batch else np.arange(len(d))
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(at), pa.int64()), *(b.column(c).take(pa.array(at)) for c in ids), pa.array(d[at])], names=["qid", *ids, "ham"])

    got = keyed.select(*ids, "key").mapInArrow(work, "qid long, " + ", ".join(f"{c} {kinds[c]}" for c in ids) + ", ham long")
    return got.withColumn("sem", angular(F.col("ham"), bits))


def chunk_scores(window_scores: DataFrame) -> DataFrame:
    """(qid, doc_id, chunk, sem): each chunk's best covering window."""
    own = window_scores.withColumn("chunk", F.explode(F.sequence(F.col("win_start"), F.col("win_start") + F.col("win_len") - 1)))
    return own.groupBy("qid", "doc_id", "chunk").agg(F.max("sem").alias("sem"))


def coverage_of(wins: DataFrame) -> DataFrame:
    """(doc_id, chunk, first_win, last_win): the windows over each chunk."""
    own = wins.withColumn("chunk", F.explode(F.sequence(F.col("win_start"), F.col("win_start") + F.col("win_len") - 1)))
    return own.groupBy("doc_id", "chunk").agg(F.min("win_start").alias("first_win"), F.max("win_start").alias("last_win"))


def abstains(window_scores: DataFrame, tau: float = C.ABSTAIN_TAU) -> DataFrame:
    """(qid, sem_top, abstain): no window comes near enough to the question."""
    top = window_scores.groupBy("qid").agg(F.max("sem").alias("sem_top"))
    return top.withColumn("abstain", F.col("sem_top") < tau)
