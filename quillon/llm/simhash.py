"""SimHash near-duplicates: pigeonhole blocks, so that close fingerprints share a block, then Hamming distance."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, packed, packed_schema, parts, runs, stored, texts, unpacked, without
from .components import components, forest

BITS = 64
#: A bucket with more fingerprints than this is split by the blocks of its remaining bits.
BUCKET = 4096


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """Eight bytes: bit set where over half of the shingles' XXH64 (seed 42) have it; no words: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(line, 42)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    h = b"".join([digest(line[a : b - 1], 42) for a, b in zip(at, at[width:])])
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 255):  # sums of bytes stay below 256
        ones += np.unpackbits(np.frombuffer(h[8 * k : 8 * (k + 255)], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of docs, fp the fingerprint as a signed long. Null texts count as empty."""

    def work(batches):
        for b in batches:
            fp = b"".join([fingerprint(t, width) for t in texts(b)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(fp, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of the choices of blocks of which a pair within the distance shares one whole."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - (1 << a)) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(one, blocks - distance)]


def blocks_for(count: int, distance: int) -> int:
    """So many blocks that the fingerprints of a bucket stay few on average."""
    for blocks in range(distance + 1, distance + 5):
        if count < 4 << (BITS * (blocks - distance) // blocks):
            return blocks
    return distance + 4


def close_pairs(key: np.ndarray, fp: np.ndarray, distance: int, left: int, depth: int = 0):
    """Edges that connect what the pairs of one key within the distance connect. left: bits not yet compared."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    starts, sizes = runs(key)
    for s, n in zip(starts[sizes > BUCKET], sizes[sizes > BUCKET]):
        own = fp[s : s + n]
        bits = [i for i in range(BITS) if left >> i & 1]
        if len(bits) <= distance:  # all are close to each other
            yield own[1:], np.repeat(own[:1], n - 1)
            continue
        for k in range(distance + 1):
            mask = sum(1 << i for i in bits[len(bits) * k // (distance + 1) : len(bits) * (k + 1) // (distance + 1)])
            yield from close_pairs(mix(own & np.uint64(mask)), own, distance, left & ~mask, depth + 1)
    small = np.repeat(sizes <= BUCKET, sizes)
    key, fp = key[small], fp[small]
    gap, at = 1, np.arange(len(key))
    while True:
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            return
        near = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= distance]
        if len(near):
            yield fp[near], fp[near + gap]
        gap += 1


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints exactly as all pairs within the distance do.

    Each fingerprint goes to one bucket for each choice of blocks; a bucket gives a spanning forest of its close
    pairs, not all of them. Crowded buckets are split again by further blocks. prints: column fp, distinct.
    """
    n = parts(prints)
    masks = block_masks(blocks_for(prints.count(), distance), distance)

    def deal(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, m in enumerate(masks):
                key = mix(fp & np.uint64(m), i)
                yield packed((key % np.uint64(n)).astype(np.int32), key=key, fp=fp, which=np.full(len(fp), i, np.uint16))

    def pair(batches):
        got = unpacked(batches, key="u8", fp="u8", which="u2")
        for i in np.unique(got["which"]):
            own = got["which"] == i
            a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for x, y in close_pairs(got["key"][own], got["fp"][own], distance, ~masks[i] & (1 << BITS) - 1):
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
                if len(a) > 1 << 20:
                    a, b = forest(a, b)
            a, b = forest(a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = prints.select("fp").mapInArrow(deal, packed_schema("key", "fp", "which"))
    return dealt.repartition(n, "part").mapInArrow(pair, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp (long) and component_id for every row of docs (doc_id, text).

    Fingerprints within the distance link, and so do equal ones; component_id is the smallest doc_id of all that
    can be reached. Equal fingerprints are merged before anything is shuffled by block. Null texts count as empty
    (fingerprint zero); rows with a null doc_id keep their row and never give a component's number; repeated rows
    each get one; other columns are not read.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(prints, distance))
    prints = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    prints = stored(prints, "roots")
    ids = prints.groupBy("root").agg(F.min("low").alias("component_id"))
    of = prints.join(ids, "root").select("fp", "component_id")
    return rows.join(of, "fp")


def op2_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """docs without the rows that have an earlier near copy: of each component the smallest doc_id stays.

    Rows with a null doc_id stay. Of repeated rows of one doc_id all stay or all go.
    """
    found = near_duplicates(docs, distance, width)
    return without(docs, found.where("doc_id <> component_id"), "doc_id")
