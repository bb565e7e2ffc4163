"""From vectors back to tokens: exact look-up, nearest neighbours, and whole chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import contract as C
from ..functions import hypervectors as hv


def codebook(tokens: DataFrame, dim: int = C.DIM) -> DataFrame:
    """(token, vec) of the distinct tokens (token string), composed in the workers."""

    def work(batches):
        for b in batches:
            t = b.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array([hv.compose(x.encode(), dim) for x in t], pa.binary())], names=["token", "vec"])

    return tokens.where("token <> ''").select("token").distinct().mapInArrow(work, "token string, vec binary")


def decode_exact(vectors: DataFrame, book: DataFrame) -> DataFrame:
    """vectors (vec) with token: an equal vector's, or null; never the nearest."""
    return vectors.join(book.select("vec", "token"), "vec", "left")


def decode_nearest(vectors: DataFrame, book: DataFrame, block: int = 4096) -> DataFrame:
    """(id, token, ham): the nearest token of each vector (id, vec), the lower token on ties.

    Query vectors go to the workers in blocks; each worker gives its best, so what is shuffled is a row for each
    query and batch of the codebook.
    """
    out = None
    rows, ids = [], []

    def flush():
        nonlocal out, rows, ids
        q, own = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), list(ids)

        def work(batches):
            for b in batches:
                if b.num_rows:
                    held = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    token = b.column("token").to_pylist()
                    best = [min(zip((d := hv.hamming_rows(held, x)).tolist(), token)) for x in q]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([t for _, t in best]), pa.array([int(d) for d, _ in best], pa.int64())], names=["id", "token", "ham"])

        got = book.mapInArrow(work, "id long, token string, ham long")
        out = got if out is None else out.unionByName(got)
        rows, ids = [], []

    for r in vectors.select("id", "vec").toLocalIterator():
        rows.append(bytes(r.vec))
        ids.append(r.id)
        if len(rows) == block:
            flush()
    if rows or out is None:
        flush() if rows else None
    if out is None:
        return vectors.sparkSession.createDataFrame([], "id long, token string, ham long")
    w = Window.partitionBy("id").orderBy("ham", "token")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def decode_chunks(seqs: DataFrame, book: DataFrame, dim: int = C.DIM) -> DataFrame:
    """(doc_id, chunk, tokens) out of ordered bundles (doc_id, chunk, chunk_len, bag): each place turned back, then nearest."""
    turn = F.pandas_udf(lambda v, p: v.combine(p, lambda a, b: hv.pack(hv.rotate(hv.unpack([bytes(a)])[0], -(b * C.SEQ_STRIDE % dim))).tobytes()), "binary")
    own = seqs.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("chunk_len") - 1))).withColumn("vec", turn("bag", "p"))
    own = own.withColumn("id", F.xxhash64("doc_id", "chunk", "p")).select("id", "doc_id", "chunk", "p", "vec")
    got = own.drop("vec").join(decode_nearest(own, book), "id")
    return got.groupBy("doc_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "token"))), lambda x: x["token"]).alias("tokens"))
