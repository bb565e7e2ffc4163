"""Best-fit packing by exact complements: lengths whose sum fills a gap exactly are taken first."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import parts, stored

SIZE = 2048
SEPARATOR = 0
PIECES = "row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every row of docs; row numbers the rows of docs.

    A document is its ids and the separator. Longer ones are cut into pieces of `size`, the first of which is
    shorter where they don't come out even. Null and empty texts are the separator alone.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            rows, ids, out = b.column("row").to_pylist(), b.column("doc_id"), []
            at = []
            for i, t in enumerate(b.column("text").to_pylist()):
                own = encoder(path).encode(t or "") + SEPARATOR.to_bytes(4, "little")
                n, start = len(own) // 4, 0
                for k in range(-(-n // size)):
                    length = n % size or size if k == 0 else size
                    out.append((rows[i], k, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])))
                    at.append(i)
                    start += length
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
        encoder(path).forget()

    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(work, f"doc_id {kind}, {PIECES}")


@dataclass
class Plan:
    """sequences[k] to sequences[k] + times[k] - 1 hold the lengths of pattern k, each in its place.

    slots: (length, first rank among the pieces of that length, pattern, offset), sorted.
    """

    slots: np.ndarray
    sequences: np.ndarray
    times: np.ndarray


class Complements:
    """Lengths still available, with the pair sums that can be had from them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with this sum whose larger member is largest: small lengths stay for later."""
        large = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (self.left[large] > 0) & (self.left[gap - large] > (large == gap - large))
        at = int(ok.argmax()) if len(ok) else 0
        return (int(large[at]), gap - int(large[at])) if len(ok) and ok[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """From the largest member down; its own use counts against what the pair may take."""
        for a in np.flatnonzero(self.left[: gap - 1])[::-1]:
            self.left[a] -= 1
            rest = self.pair(gap - int(a)) if gap - a >= 2 else None
            self.left[a] += 1
            if rest and rest[0] <= a:
                return (int(a), *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or (self.pair(gap) if gap >= 2 else None) or (self.triple(gap) if gap >= 3 else None)


def plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    """Patterns of lengths for counts[l] pieces of each length l; their number is bounded by the number of lengths.

    The longest length left starts a sequence. Its gap is filled exactly by one, two or three lengths if it can
    be; else by the longest length that fits, and what remains is tried again. A pattern is repeated while its
    lengths last, so that each round uses up a length.
    """
    have = Complements(counts)
    used = np.zeros(size + 1, np.int64)
    slots, sequences, times, first = [], [], [], 0
    for longest in range(size, 0, -1):
        while have.left[longest]:
            own, gap = [longest], size - longest
            have.left[longest] -= 1
            while gap:
                fill = have.exact(gap)
                if fill is None:
                    fits = np.flatnonzero(have.left[: gap + 1])
                    if not len(fits):
                        break
                    fill = (int(fits[-1]),)
                for x in fill:
                    have.left[x] -= 1
                own += fill
                gap -= sum(fill)
            lengths, needs = np.unique(own, return_counts=True)
            have.left[lengths] += needs
            n = int((have.left[lengths] // needs).min())
            offset = 0
            for x in own:
                slots.append((x, used[x], len(times), offset))
                used[x] += n
                have.left[x] -= n
                offset += x
            sequences.append(first)
            times.append(n)
            first += n
    slots.sort()
    return Plan(np.array(slots, np.int64).reshape(-1, 4), np.array(sequences, np.int64), np.array(times, np.int64))


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """rows with rank: 0, 1, ... among the rows of its length. A frequent length is dealt to many tasks first."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    own = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = own.withColumn("before", F.expr("sum(n) over (partition by length order by salt) - n")).drop("n")
    local = rows.withColumn("k", F.expr("row_number() over (partition by length, salt order by row, piece) - 1"))
    return local.join(before, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("before")).drop("salt", "k", "before")


def packed_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of docs.

    The plan is made from the counts of pieces of each length (at most `size` numbers) and then met by rank, so no
    piece goes to the driver. Rows with a null doc_id and repeated rows are packed like any others, under their
    doc_id; null texts count as empty; an empty table gives no rows; other columns are not read.
    """
    rows = stored(pieces(docs, path, size), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    held = docs.sparkSession.sparkContext.broadcast(plan(counts, size))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def place(batches):
        p = held.value
        keys = p.slots[:, 0] << np.int64(44) | p.slots[:, 1]  # a length and a rank below 2**44
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << np.int64(44) | rank, "right") - 1
            slot = p.slots[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(p.sequences[slot[:, 2]] + rank - slot[:, 1]), pa.array(slot[:, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    salts = max(8, min(1024, parts(docs)))
    return ranked(rows, salts).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
