"""Readers and writers: text files, XML dumps, vector files and vocabularies."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C

#: The layout of a vector file's header, little-endian, 128 bytes.
HEADER = struct.Struct("<8sIII16sQI32s32s16x")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, note) of .txt, .md and .pdf files. Malformed UTF-8 becomes U+FFFD with a note; a PDF that
    can't be read, and files of other kinds, have a null text and say why."""
    raw = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    own = raw.select("path", kind.alias("kind"), "content")
    plain = own.where(F.col("kind").isin(".txt", ".md")).select(
        "path", "kind", F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.when(~F.is_valid_utf8(F.col("content").cast("string")), "malformed UTF-8 replaced").alias("note"),
    )

    def pdf(batches):
        for b in batches:
            texts, notes = [], []
            for c in b.content:
                try:
                    import io

                    from pypdf import PdfReader

                    texts.append("\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages))
                    notes.append(None)
                except Exception as e:  # one bad file is one skipped row
                    texts.append(None)
                    notes.append(f"skipped: {e}")
            yield pd.DataFrame({"path": b.path, "kind": b.kind, "text": pd.Series(texts, dtype=object), "note": pd.Series(notes, dtype=object)})

    pdfs = own.where("kind = '.pdf'").mapInPandas(pdf, "path string, kind string, text string, note string")
    rest = own.where(~F.col("kind").isin(".txt", ".md", ".pdf")).select("path", "kind", F.lit(None).cast("string").alias("text"), F.lit("skipped: not a kind of text").alias("note"))
    return plain.unionByName(pdfs).unionByName(rest)


def document_id(path):
    """The identity of a source: equal paths are one document, which a later version replaces."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(path, r"[\\/]+", "/")), 256), 1, 16)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of an XML dump (also .bz2), one row each."""
    schema = "ns INT, title STRING, redirect STRUCT<_title: STRING>, revision STRUCT<text: STRING>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)


def write_vectors(rows: DataFrame, path: str, magic: bytes, source: bytes = bytes(32)) -> str:
    """Writes (index, vec) as one vector file, by rising index; returns the payload's SHA-256.

    A codebook is a vocabulary's size, which one writer streams; nothing else is written this way.
    """
    sha, n = hashlib.sha256(), 0
    with open(path, "wb") as out:
        out.write(bytes(HEADER.size))
        for r in rows.orderBy("index").toLocalIterator():
            out.write(r.vec)
            sha.update(r.vec)
            n += 1
        out.seek(0)
        out.write(HEADER.pack(magic, C.FILE_VERSION, C.DIM, C.DIM // 64, C.PRNG_ID, C.SEED, n, source, sha.digest()))
    return sha.hexdigest()


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise C.StoreError(f"{path}: no header")
    names = ("magic", "version", "dim", "words", "prng", "seed", "n", "source", "payload_sha256")
    return dict(zip(names, HEADER.unpack(raw))) | {"prng": HEADER.unpack(raw)[4].rstrip(b"\0")}


def read_vectors(spark: SparkSession, path: str, magic: bytes, verify: bool = True) -> DataFrame:
    """(index, vec) of a vector file; each field of its header, its length and its checksum must be right."""
    h = read_header(path)
    want = {"magic": magic, "version": C.FILE_VERSION, "dim": C.DIM, "words": C.DIM // 64, "prng": C.PRNG_ID, "seed": C.SEED}
    if wrong := [k for k, v in want.items() if h[k] != v]:
        raise C.StoreVersionError(f"{path}: {', '.join(wrong)} is not as expected")
    payload = np.fromfile(path, np.uint8, offset=HEADER.size)
    if len(payload) != h["n"] * C.DIM // 8 or verify and hashlib.sha256(payload.tobytes()).digest() != h["payload_sha256"]:
        raise C.StoreError(f"{path}: the payload is not what its header says")
    rows = payload.reshape(h["n"], -1)
    return spark.createDataFrame(pd.DataFrame({"index": range(h["n"]), "vec": [r.tobytes() for r in rows]}), "index long, vec binary")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(id, bytes, special) of a tokenizer.json; with sha256 given, the file must have it."""
    raw = spark.read.format("binaryFile").load(path).select("content").first().content
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise C.StoreError(f"{path} is not the pinned file")
    doc, letters = json.loads(raw), byte_letters()
    special = {x["content"] for x in doc.get("added_tokens", ())}
    rows = [(i, t.encode() if t in special else bytes(letters[c] for c in t), t in special) for t, i in doc["model"]["vocab"].items()]
    return spark.createDataFrame(rows, "id long, bytes binary, special boolean")


def synthetic(spark: SparkSession, tokens: int = 1_000_000, docs: int = 20, vocabulary: int = 50_000, seed: int = 0xB0B57011, k: int = C.CHUNK) -> DataFrame:
    """(doc, pos, token_id): Zipf(1.3) body, 15 % from a small pool, 5 % one token, needles and a sentinel in place."""
    per = tokens // docs
    zipf = F.least(F.lit(vocabulary - 1), F.floor(F.pow(F.rand(seed) + 1e-12, F.lit(-1 / 0.3))) - 1).cast("long")
    mixed = F.pmod(zipf * 7919 + 13, F.lit(vocabulary))
    own = spark.range(tokens).select(F.floor(F.col("id") / per).cast("int").alias("doc"), (F.col("id") % per).cast("int").alias("pos"), F.rand(seed + 1).alias("u"), F.floor(F.rand(seed + 2) * 64).cast("long").alias("pool"), mixed.alias("z"))
    body = F.when(F.col("u") < 0.05, F.lit(7)).when(F.col("u") < 0.20, F.col("pool")).otherwise(F.col("z"))
    needle = (F.col("doc") < 5) & F.col("pos").between(10 * k, 11 * k - 1)
    sentinel = (F.col("doc") == 0) & F.col("pos").between(20 * k, 21 * k - 1)
    token = F.when(needle, vocabulary + F.col("doc") * k + F.col("pos") % k).when(sentinel, F.lit(vocabulary + 1000)).otherwise(body)
    return own.select("doc", "pos", token.alias("token_id"))
