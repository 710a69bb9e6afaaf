"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes (each byte's table value is added to the doubled hash, so it
depends on the last 32 bytes only) and is computed for all positions at once.  Chunking is normalised: up to
the target length a boundary needs more zero bits than beyond it, which draws chunk lengths towards the
target; boundaries follow content, so an insertion moves no boundary further on.  A fingerprint is the
text's chunk digests with their lengths; the likeness of one fingerprint to another is the share of its
bytes in chunks whose digests the other holds too (weighted containment).

The query's next document is found with no global sort: ids are cut into ranges at quantiles, each range's
rows are sorted in its own task, and the first row of each range is also sent to the range before.  An id
with more rows than a range should hold is a range of its own, cut further by a hash of the text.

Defined cases: null text counts as empty, with an empty fingerprint; an empty fingerprint is contained
in any (likeness 1) if the other is empty and has likeness 0 otherwise; rows that share an id come by a
hash of the text, then by text; null ids come last; a single row is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, partitions, small_slices, table, texts_of

LEAST, TARGET, MOST = 16, 64, 256
#: Zero bits that a boundary needs before and beyond the target length.
STRICT, LOOSE = 8, 4
DIGEST = 12
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """The hash after each byte; by doubling: the hash over 2n bytes is two of those over n."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for n in (1, 2, 4, 8, 16):
        h[n:] += h[:-n].copy() << np.uint32(n)
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    # High bits depend on the whole window.
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0] + 1
    loose = (loose + 1).tolist()
    strict = strict.tolist()
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        while i < len(strict) and strict[i] < at + LEAST:
            i += 1
        if i < len(strict) and strict[i] <= at + TARGET:
            at = strict[i]
        else:
            while j < len(loose) and loose[j] <= at + TARGET:
                j += 1
            at = min(n, at + MOST, loose[j] if j < len(loose) else n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(text: str) -> list[tuple[str, int]]:
    """Digest and length of each chunk of the text's UTF-8 bytes."""
    data = text.encode("utf-8", "replace")
    ends = cut_points(data)
    return [(xxhash.xxh3_64_hexdigest(data[s:e])[:DIGEST], e - s) for s, e in zip([0, *ends], ends)]


def fingerprint(parts: list[tuple[str, int]]) -> str:
    return " ".join([f"{d}:{n}" for d, n in parts])


def containment(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> float:
    """Share of a's distinct chunks, by length, that b holds too."""
    if not a:
        return 1.0 if not b else 0.0
    mine, theirs = dict(a), {d for d, _ in b}
    return sum(n for d, n in mine.items() if d in theirs) / sum(mine.values())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranges(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut docs into about n ranges of equal size, ascending."""
    row = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first()
    return sorted({int(x) for x in row["q"] or []})


def with_part(docs: DataFrame) -> DataFrame:
    """doc_id, text, place (orders the rows of an id), part: a range of ids, of a frequent id a range of places; part grows as ids fall and places rise."""
    spark = docs.sparkSession
    rows = texts_of(docs).withColumn("place", F.shiftrightunsigned(F.xxhash64("text"), 1))
    n = max(2, 8 * partitions(spark))
    cuts = ranges(rows, n)
    total = rows.count()
    # Ids with more rows than a range should hold: fewer than there are ranges.
    frequent = {r["doc_id"]: math.ceil(r["count"] * n / total) for r in rows.groupBy("doc_id").count().where(F.col("count") > total / n).collect()} if total > n else {}
    known = [i for i in frequent if i is not None]
    cuts = sorted({*cuts, *known, *(i + 1 for i in known)})
    most = max(frequent.values(), default=1)
    pieces = functools.reduce(lambda c, i: c.when(F.col("doc_id").eqNullSafe(F.lit(i)), F.lit(frequent[i])), frequent, F.when(F.lit(False), 1)).otherwise(F.lit(1))
    sub = F.least(F.floor(F.col("place") / float(1 << 63) * pieces), pieces - 1).cast("long")
    if not cuts:
        return rows.withColumn("part", sub)
    splits = [-math.inf, *dict.fromkeys(map(float, cuts)), math.inf]
    found = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(rows.withColumn("_at", F.col("doc_id").cast("double")))
    part = F.coalesce(F.when(F.col("doc_id").isNotNull(), len(splits) - 2 - F.col("_bucket")), F.lit(len(splits) - 1)).cast("long")
    return found.select("doc_id", "text", "place", (part * most + sub).alias("part"))


def _with_following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    before = None  # part, own, doc_id, text, chunks
    rows: list[tuple] = []
    for batch in small_slices(batches):
        for part, own, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
            parts = chunks(text)
            if before is not None and before[0] == part and before[1]:
                text0, parts0 = before[3], before[4]
                changed = edited(text0, text)
                parts1 = chunks(changed)
                rows.append(
                    (
                        before[2], len(text0), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), fingerprint(parts0),
                        fingerprint(parts1), containment(parts0, parts1), containment(parts0, parts),
                    )
                )
            before = (part, own, doc, text, parts)
        if rows:
            yield batch_of(dict(zip(schema.names, zip(*rows))), schema)
            rows = []


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint and the edited text's, and likenesses, of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    rows = with_part(docs)
    # The first row of each part (largest id, then least place) is also sent to the part before; that of the first closes the ring.
    # As many rows as ranges and pieces of frequent ids: a few times 8 * partitions.
    heads = rows.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("down"), "place")).alias("head")).select("part", (-F.col("head.down")).alias("head"), F.col("head.place").alias("place")).orderBy("part").collect()
    order = [r["part"] for r in heads]
    firsts = spark.createDataFrame([(r["part"], r["head"], r["place"], order[i - 1]) for i, r in enumerate(heads)], "part long, head long, first long, goes_to long")
    is_head = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("place") == F.col("first"))
    own = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    lent = F.struct(F.col("goes_to").alias("part"), F.lit(False).alias("own"))
    dealt = (
        rows.join(F.broadcast(firsts), "part")
        .select("doc_id", "text", "place", F.inline(F.when(is_head, F.array(own, lent)).otherwise(F.array(own))).alias("part", "own"))
        .repartition(partitions(spark), "part")
        .sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "place", "text")
    )
    return dealt.select("part", "own", "doc_id", "text").mapInArrow(
        _with_following, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
