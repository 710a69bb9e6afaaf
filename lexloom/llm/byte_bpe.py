"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap; each chunk is pre-tokenised on its own.  Where the boundaries
that two neighbours found in their common stretch agree (and no white space precedes, so no look-ahead of
the pattern reaches over it), both have the same pre-tokens from there on: the text is cut there and the
pieces are encoded on their own.  Where neighbours never agree (one pre-token longer than the overlap) their
chunks are joined into one piece, so the result always equals the encoding of the whole text.  Decoding
concatenates the pieces' raw bytes.

A text of up to ``spread`` code points has its chunks (of ``chunk``, overlapping by ``overlap``) worked on
where it lies.  A longer one is first spread over the cluster by the same rule, in chunks of ``spread``
that overlap by ``overlap``; its pieces are then chunked where they lie, and put together by their order.

Defined cases: null text counts as empty and gives no ids; repeated rows are each encoded (they keep
apart by a row key); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import batch_of, partitions, small_slices, table, texts_of

CHUNK = 2_048
SPREAD = 32_768
OVERLAP = 128


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode_ids(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


#: A cut may follow any pre-token that does not end in white space.
_SPACE = regex.compile(r"\s")
_PATTERN = regex.compile(public_tokenizers.PATTERN)


def ends(text: str) -> list[int]:
    """Where the text's pre-tokens end."""
    found = [*accumulate(map(len, _PATTERN.findall(text)))]
    # Matches that leave characters out, or a pattern with groups, need the slower way.
    return found if not text or found and found[-1] == len(text) else [m.end() for m in _PATTERN.finditer(text)]


def boundaries(text: str, from_pos: int, to_pos: int, at: list[int] | None = None) -> list[int]:
    """Safe cut positions found by pre-tokenising text, within [from_pos, to_pos); at: the ends, if known."""
    at = ends(text) if at is None else at
    return [e for e in at[bisect_left(at, from_pos) : bisect_left(at, to_pos)] if not _SPACE.match(text[e - 1])]


def seams(text: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Of a chunk with its overlap: the safe cuts in the stretch shared with the chunk before, and those shared with the next, counted from where that begins."""
    at = ends(text)
    return boundaries(text, 1, overlap, at), [c - chunk for c in boundaries(text, chunk, min(chunk + overlap, len(text)), at)]


def stitched(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text in pieces, cut where its overlapping chunks resynchronise."""
    if len(text) <= chunk:
        return [text]
    found = [seams(text[at : at + chunk + overlap], chunk, overlap) for at in range(0, len(text), chunk)]
    cuts = [0]
    for k in range(1, len(found)):
        both = set(found[k - 1][1]).intersection(found[k][0])
        if both:
            cuts.append(k * chunk + min(both))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def encode_bytes(enc: tiktoken.Encoding, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """The ids of the text's pieces, one after the other."""
    ids: list[int] = []
    for piece in stitched(text, chunk, overlap):
        ids += enc.encode_ordinary(piece)
    return np.asarray(ids, dtype="<u4").tobytes()


_CUTS = "part string, k int, text string, head array<int>, tail array<int>"


def _pretokenise(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("k", pa.int32()), ("text", pa.string()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])
    for batch in small_slices(batches):
        texts = batch.column("text").to_pylist()
        heads, tails = zip(*[seams(t, chunk, overlap) for t in texts])
        yield batch_of({"part": batch.column("part"), "k": batch.column("k"), "text": texts, "head": heads, "tail": tails}, schema)


def pieces(long_docs: DataFrame, chunk: int = SPREAD, overlap: int = OVERLAP) -> DataFrame:
    """(part, k, text): the long texts of (part, text) cut where their chunks resynchronise; texts by k give the whole."""
    n = F.length("text")
    cut = (
        long_docs.select("part", "text", F.explode(F.sequence(F.lit(0), ((n - 1) / chunk).cast("int"))).alias("k"))
        .select("part", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition(partitions(long_docs.sparkSession), "part", "k")
    )
    cut = cut.mapInArrow(functools.partial(_pretokenise, chunk=chunk, overlap=overlap), _CUTS)
    by_doc = W.Window.partitionBy("part").orderBy("k")
    synced = (
        cut.withColumn("until", F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc))))
        .withColumn("begin", F.lag("until").over(by_doc))
        .withColumn("last", F.lead("k").over(by_doc).isNull())
        .withColumn("piece", F.sum(F.when(F.col("begin").isNotNull() | (F.col("k") == 0), 1).otherwise(0)).over(by_doc))
    )
    begin = F.coalesce("begin", F.lit(0))
    end = F.when(F.col("last"), F.length("text")).otherwise(F.lit(chunk) + F.coalesce("until", F.lit(0)))
    own = synced.select("part", "piece", "k", F.substring("text", begin + 1, end - begin).alias("text"))
    return own.groupBy("part", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text")
    ).select("part", F.col("piece").cast("int").alias("k"), "text")


_IDS = "part string, k int, ids binary, raw binary"


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    schema = pa.schema([("part", pa.string()), ("k", pa.int32()), ("ids", pa.binary()), ("raw", pa.binary())])
    for batch in small_slices(batches):
        ids = [encode_bytes(enc, t) for t in batch.column("text").to_pylist()]
        yield batch_of({"part": batch.column("part"), "k": batch.column("k"), "ids": ids, "raw": [decode_ids(enc, i) for i in ids]}, schema)


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    for batch in small_slices(batches):
        ids = [encode_bytes(enc, t) for t in batch.column("text").to_pylist()]
        yield batch_of(
            {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(decode_ids(enc, i)).hexdigest() for i in ids],
            },
            schema,
        )


def encode(docs: DataFrame, path: str, spread: int = SPREAD, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (bytes) of every row of docs(doc_id, text)."""
    from_row = texts_of(docs)
    small = from_row.where(F.length("text") <= spread).mapInArrow(functools.partial(_whole, path=path), "doc_id long, ids binary, decoded binary")
    large = _long(from_row.where(F.length("text") > spread), path, spread, overlap)
    return small.unionByName(large.select("doc_id", "ids", F.col("raw").alias("decoded")))


def _long(long_docs: DataFrame, path: str, spread: int, overlap: int) -> DataFrame:
    """doc_id, ids, raw of every long row.

    A row's key is a hash of its id and text, so equal ids don't mix; rows that repeat both are coded once and expanded by their count.
    """
    keyed = long_docs.withColumn("part", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "text"), 256))
    counts = keyed.groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    cut = pieces(keyed.select("part", "text").dropDuplicates(["part"]), spread, overlap)
    return _joined(cut, path).join(counts, "part").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "ids", "raw")


def _whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
    for batch in small_slices(batches):
        ids = [encode_bytes(enc, t) for t in batch.column("text").to_pylist()]
        yield batch_of({"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [decode_ids(enc, i) for i in ids]}, schema)


def _joined(cut: DataFrame, path: str) -> DataFrame:
    enc = cut.mapInArrow(functools.partial(_encode, path=path), _IDS)
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids", "raw")))
    return (
        enc.groupBy("part")
        .agg(ordered.alias("all"))
        .select(
            "part",
            # Joined as text once: adding up binaries would copy what is there for every piece.
            *(F.unhex(F.array_join(F.transform(F.col("all")[c], F.hex), "")).alias(c) for c in ("ids", "raw")),
        )
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, raw binary of (doc_id, ids binary): the concatenated bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])
        for b in batches:
            yield batch_of({"doc_id": b.column("doc_id"), "raw": [decode_ids(enc, i or b"") for i in b.column("ids").to_pylist()]}, schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str, spread: int = SPREAD, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: n_tokens and SHA-256 of the ids and of the decoded bytes.

    Only texts over ``spread`` code points are shuffled.
    """
    from_row = texts_of(docs)
    short = from_row.where(F.length("text") <= spread)
    small = short.mapInArrow(functools.partial(_digest, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    large = _long(from_row.where(F.length("text") > spread), path, spread, overlap)
    return small.unionByName(
        large.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
