"""LM scoring by a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end per text.  A token's context is the previous word (16 bits of its
hash; the beginning of a text is a word of its own) together with the class of the last non-ASCII letter so
far in its text (4 bits).  Each context is a restaurant whose parent is its class's; the classes' restaurants
share the unigram restaurant as parent, whose base is uniform over the known words and one unknown word.
Customers are seated as in the Chinese restaurant process: a Gibbs sweep draws, for all dishes and level by
level, the tables of a dish anew given the other counts (a blocked move; within a sweep the restaurants'
totals are those of the sweep before, as in distributed samplers).  After burn-in the predictive
probabilities of the sweeps are averaged; their logarithms are the score.

What makes it scale: a block of texts (about ``block_chars``) becomes one list of distinct (word, context)
entries with counts, keyed by a hash of the word, and its texts' tokens become indices into that list.  Only
the lists are dealt by ranges of the word's hash, so all of a word's restaurants meet in one task, a
frequent word comes once from each block, and no task needs the vocabulary; there are as many ranges as the
text's length asks for.  Between sweeps only the restaurants' totals (two numbers for each of a million
contexts, whatever the corpus, added up in slices) pass through the driver.  The averaged probabilities go
back block by block.

docs must give the same rows in the same order when read twice (a table does): the texts' tokens are made
in a second pass rather than stored, and a check of each block's entries fails the job should they differ.

Defined cases: null text counts as empty (its end is its only token); repeated rows count and are scored
each; without training texts every token is unknown; extra columns are ignored.  Words are told apart by 44
bits of their XXH3 hash, contexts by 20.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, id_remainder, lower_ascii, partitions, small_slices, stored, table

BLOCK_CHARS = 20_000_000
#: Code points of text for each range of words.
RANGE_CHARS = 16_000_000
SWEEPS = 4
BURN_IN = 1
STRENGTH = (20.0, 10.0, 5.0)
END, BEGIN = xxhash.xxh3_64_intdigest(b"\n end \n"), xxhash.xxh3_64_intdigest(b"\n begin \n")
CONTEXT_BITS = 20
UPPER_BITS = 4
LOWER_BITS = CONTEXT_BITS - UPPER_BITS
CONTEXT_MASK = np.uint64((1 << CONTEXT_BITS) - 1)
LOWER_MASK = np.uint64((1 << LOWER_BITS) - 1)
#: Restaurants of the levels 0, 1, 2, where each level begins in the list of all, and contexts in a slice of it.
SIZES, OFFSETS = (1, 1 << UPPER_BITS, 1 << CONTEXT_BITS), ((1 << CONTEXT_BITS) + (1 << UPPER_BITS), 1 << CONTEXT_BITS, 0)
SLICE = 1 << 14

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of numbers resemble each other."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _pack_ascending(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_ascending(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(_unpack(data, dtype), dtype=dtype)


def token_keys(text: str) -> np.ndarray:
    """Of each token, and of the end: 52 bits of the word's hash and 12 of the context."""
    low = lower_ascii(text)
    words = low.split()
    keys = np.empty(len(words) + 1, np.uint64)
    keys[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    keys[-1] = END
    contexts = np.empty(len(words) + 1, np.uint64)
    contexts[0] = BEGIN & int(LOWER_MASK)
    # The high bits of a word's hash are its key, so its context takes low ones.
    contexts[1:] = keys[:-1] & LOWER_MASK
    raw = np.frombuffer(low, np.uint8)
    # The last non-ASCII character's last byte up to the end of the previous word.
    marks = np.flatnonzero(raw >= 0x80)
    if words and len(marks):
        inside = ~_SPACE[raw]
        last = np.flatnonzero(inside & np.r_[~inside[1:], True])  # last byte of each word
        k = np.searchsorted(marks, last, side="right")
        upper = np.where(k > 0, 1 + (raw[marks[np.maximum(k, 1) - 1]] & 63) % ((1 << UPPER_BITS) - 1), 0).astype(np.uint64)
        contexts[1:] |= upper << np.uint64(LOWER_BITS)
    return keys & ~CONTEXT_MASK | contexts


#: Of a block a row of its texts (dest -1), or a row of entries for each range that has some.
_ENCODED = "block long, dest int, data array<binary>"
_ENCODED_ARROW = pa.schema([("block", pa.int64()), ("dest", pa.int32()), ("data", pa.list_(pa.binary()))])
#: Stands for a null id in packed rows.
NO_ID = -(1 << 63)


def _checks(entries: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each range's entries."""
    return np.array([xxhash.xxh3_64_intdigest(entries[a:b].tobytes()) for a, b in zip(cut, np.r_[cut[1:], len(entries)])], np.uint64)


def _encode(batches: Iterator[pa.RecordBatch], ranges: int, block_chars: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Of each block the row of its texts (ids, training flags, token counts, indices of entries, checks of its ranges), or its rows of entries."""
    block, keys, ids, train, chars = 0, [], [], [], 0

    def rows() -> pa.RecordBatch:
        n = np.array([len(k) for k in keys], np.int32)
        entries, index = np.unique(np.concatenate(keys), return_inverse=True)
        dest = _range_of(entries, ranges)
        cut = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]])
        if texts:
            data = [[_pack(np.array(ids, np.int64)), _pack(np.array(train)), _pack(n), _pack(index.astype(np.uint32)), _pack(_checks(entries, cut))]]
            return batch_of({"block": [block], "dest": [-1], "data": data}, _ENCODED_ARROW)
        learned = np.bincount(index[np.repeat(np.array(train), n)], minlength=len(entries)).astype(np.uint32)
        data = [[_pack_ascending(entries[a:b]), _pack(learned[a:b])] for a, b in zip(cut, np.r_[cut[1:], len(entries)])]
        return batch_of({"block": [block] * len(data), "dest": dest[cut], "data": data}, _ENCODED_ARROW)

    for batch in small_slices(batches):
        block = block or batch.column("part")[0].as_py() << 24
        for doc, learn, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text"))):
            keys.append(token_keys(text))
            ids.append(NO_ID if doc is None else doc)
            train.append(bool(learn))
            chars += len(text) + 1
            if chars >= block_chars:
                yield rows()
                block, keys, ids, train, chars = block + 1, [], [], [], 0
    if keys:
        yield rows()


def _range_of(entries: np.ndarray, ranges: int) -> np.ndarray:
    return ((entries >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


_MERGED = "dest int, entries binary, counts binary, blocks array<long>, places array<binary>, checks array<long>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by dest: one row with the range's entries, their training counts, and each block's places among them."""
    schema = pa.schema([("dest", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("checks", pa.list_(pa.int64()))])

    def merged(dest: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([p[1] for p in parts])
        entries, index = np.unique(keys, return_inverse=True)
        counts = np.bincount(index, np.concatenate([p[2] for p in parts]), len(entries)).astype(np.int64)
        ends = np.cumsum([len(p[1]) for p in parts])
        places = [_pack_ascending(x.astype(np.uint32)) for x in np.split(index, ends[:-1])]
        checks = [int(_checks(p[1], np.zeros(1, np.int64)).view(np.int64)[0]) for p in parts]
        return batch_of({"dest": [dest], "entries": [_pack_ascending(entries)], "counts": [_pack(counts)], "blocks": [[p[0] for p in parts]], "places": [places], "checks": [checks]}, schema)

    now, parts = None, []
    for batch in batches:
        for dest, block, data in zip(*(batch.column(c).to_pylist() for c in ("dest", "block", "data"))):
            if dest != now and parts:
                yield merged(now, parts)
                parts = []
            now = dest
            parts.append((block, _unpack_ascending(data[0], np.uint64), _unpack(data[1], np.uint32)))
    if parts:
        yield merged(now, parts)


def seat(counts: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers sit down one after the other; `new` is the weight of a new table, (strength + discount * tables of the restaurant) * parent's probability.

    The first 128 customers are seated one by one, later ones in groups of a sixteenth of those seated before.
    """
    tables = np.minimum(counts, 1)
    order = np.argsort(-counts, kind="stable")
    left = counts[order]
    weight, t = new[order], tables[order].astype(np.float64)
    j, n = 1, int((left > 1).sum())
    while n:
        step = 1 if j < 128 else j // 16
        take = np.minimum(step, left[:n] - j)
        rate = np.clip(weight[:n] / np.maximum(1e-9, j - discount * t[:n] + weight[:n]), 0, 1)
        t[:n] += rng.random(n) < rate if step == 1 else rng.binomial(take, rate)
        j += step
        n = int(np.searchsorted(-left[:n], -j, side="left"))
    out = np.empty_like(t)
    out[order] = t
    return np.minimum(out, counts).astype(np.int64)


class Seating:
    """Restaurants of the words of one range.  Levels: 2 lower contexts, 1 upper contexts, 0 unigram."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, dest: int):
        self.dest = dest
        self.context = (entries & CONTEXT_MASK).astype(np.int64)
        self.c2 = counts
        pair = entries >> np.uint64(LOWER_BITS)  # word and upper context
        word = entries >> np.uint64(CONTEXT_BITS)
        first1 = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        first0 = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        self.upper_of = np.repeat(np.arange(len(first1)), np.diff(np.r_[first1, len(entries)]))
        self.word_of = np.searchsorted(first0, first1, side="right") - 1
        self.first1, self.first0 = first1, np.searchsorted(first1, first0)
        self.upper = self.context[first1] >> LOWER_BITS
        self.word_counts = np.add.reduceat(counts, first0)
        self.t2 = np.minimum(self.c2, 1)
        self._customers()
        self.t1 = np.minimum(self.c1, 1)
        self._customers()
        self.t0 = np.minimum(self.c0, 1)

    def _customers(self) -> None:
        self.c1 = np.add.reduceat(self.t2, self.first1)
        if hasattr(self, "t1"):
            self.c0 = np.add.reduceat(self.t1, self.first0)
        else:
            self.c0 = np.add.reduceat(np.minimum(self.c1, 1), self.first0)

    def add_totals(self, sums: np.ndarray, extras: np.ndarray) -> None:
        """Adds each restaurant's customers and tables; and tokens, words, and by level the dishes with one and with two customers."""
        extras[:2] += self.word_counts.sum(), (self.word_counts > 0).sum()
        for level, context, c, t in ((2, self.context, self.c2, self.t2), (1, self.upper, self.c1, self.t1), (0, np.zeros(len(self.c0), np.int64), self.c0, self.t0)):
            at = OFFSETS[level]
            for k, x in enumerate((c, t)):
                sums[k, at : at + SIZES[level]] += np.bincount(context, x, SIZES[level]).astype(np.int64)
            extras[2 + level] += (c == 1).sum()
            extras[5 + level] += (c == 2).sum()

    def probabilities(self, g: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities of the present seating, of words, upper and lower entries."""
        d, s = g.discount, STRENGTH
        p0 = (np.maximum(0, self.c0 - d[0] * self.t0) + (s[0] + d[0] * g.tables[0][0]) * g.base) / (s[0] + g.customers[0][0])
        p1 = (np.maximum(0, self.c1 - d[1] * self.t1) + (s[1] + d[1] * g.tables[1][self.upper]) * p0[self.word_of]) / (s[1] + g.customers[1][self.upper])
        p2 = (np.maximum(0, self.c2 - d[2] * self.t2) + (s[2] + d[2] * g.tables[2][self.context]) * p1[self.upper_of]) / (s[2] + g.customers[2][self.context])
        return p0, p1, p2

    def sweep(self, g: Totals, number: int) -> None:
        """All tables drawn anew, given the totals g."""
        rng = np.random.default_rng((number, self.dest))
        d, s = g.discount, STRENGTH
        p0, p1, _ = self.probabilities(g)
        self.t2 = seat(self.c2, (s[2] + d[2] * g.tables[2][self.context]) * p1[self.upper_of], d[2], rng)
        self._customers()
        self.t1 = seat(self.c1, (s[1] + d[1] * g.tables[1][self.upper]) * p0[self.word_of], d[1], rng)
        self._customers()
        self.t0 = seat(self.c0, (s[0] + d[0] * g.tables[0][0]) * np.full(len(self.c0), g.base), d[0], rng)


class Totals:
    """Customers and tables of all restaurants, discounts, and the base probability."""

    def __init__(self, rows: list, before: Totals | None = None):
        sums, extras = np.zeros((2, sum(SIZES)), np.int64), np.zeros(8, np.int64)
        for r in rows:
            if r["slice"] < 0:
                extras = _unpack(r["data"], np.int64)
            else:
                part = _unpack(r["data"], np.int64).reshape(2, -1)
                sums[:, r["slice"] * SLICE : r["slice"] * SLICE + part.shape[1]] = part
        self.tokens, self.words = int(extras[0]), int(extras[1])
        of_level = lambda x: [x[at : at + n].astype(np.float32) for at, n in zip(OFFSETS, SIZES)]
        self.customers, self.tables = of_level(sums[0]), of_level(sums[1])
        if before:
            self.customers[2] = before.customers[2]  # they never change
        # The usual estimate from dishes with one and with two customers, kept from the first totals on.
        self.discount = before.discount if before else tuple(float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5 for a, b in zip(extras[2:5], extras[5:8]))
        self.base = 1 / (self.words + 1)
        self.first = before is None

    def __getstate__(self) -> dict:
        """Packed: most contexts of a small corpus are empty, and those of the lower level keep their customers."""
        arrays = [*self.customers[: 3 if self.first else 2], *self.tables]
        return self.__dict__ | {"customers": len(arrays) - 3, "tables": [_pack(x.astype(np.uint64)) for x in arrays]}

    def __setstate__(self, state: dict) -> None:
        arrays = [_unpack(x, np.uint64).astype(np.float32) for x in state["tables"]]
        self.__dict__.update(state | {"customers": arrays[: state["customers"]], "tables": arrays[state["customers"] :]})


def _past(history: list) -> list[Totals]:
    """The totals that broadcasts hold, one each."""
    past = [h.value for h in history]
    for g in past[1:]:
        g.customers[2:] = past[0].customers[2:]
    return past


_TOTALS = "slice int, data binary"
_TOTALS_ARROW = pa.schema([("slice", pa.int32()), ("data", pa.binary())])


def _seated(row: dict, history: list[Totals]) -> Iterator[tuple[int, Seating]]:
    """The seating of a merged row before the first sweep and after each that history allows."""
    seating = Seating(_unpack_ascending(row["entries"], np.uint64), _unpack(row["counts"], np.int64), row["dest"])
    yield 0, seating
    for number, g in enumerate(history, 1):
        seating.sweep(g, number)
        yield number, seating


def _sum_totals(batches: Iterator[pa.RecordBatch], history) -> Iterator[pa.RecordBatch]:
    """The task's sums of totals, in slices that are not all zero."""
    sums, extras, past = np.zeros((2, sum(SIZES)), np.int64), np.zeros(8, np.int64), _past(history)
    for batch in batches:
        for row in batch.to_pylist():
            seating = None
            for _, seating in _seated(row, past):  # noqa: B007
                pass
            seating.add_totals(sums, extras)
    if extras.any() or sums.any():
        parts = [(k, sums[:, k * SLICE : (k + 1) * SLICE]) for k in range(math.ceil(sums.shape[1] / SLICE))]
        parts = [(k, _pack(x.ravel())) for k, x in parts if x.any()] + [(-1, _pack(extras))]
        yield batch_of(dict(zip(_TOTALS_ARROW.names, zip(*parts))), _TOTALS_ARROW)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come by slice."""
    now, total = None, None
    for batch in batches:
        for k, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
            if k != now and total is not None:
                yield batch_of({"slice": [now], "data": [_pack(total)]}, _TOTALS_ARROW)
                total = None
            now, part = k, _unpack(data, np.int64)
            total = part if total is None else total + part
    if total is not None:
        yield batch_of({"slice": [now], "data": [_pack(total)]}, _TOTALS_ARROW)


_MODELLED = "block long, dest int, data array<binary>"


def _average(batches: Iterator[pa.RecordBatch], history, burn_in: int) -> Iterator[pa.RecordBatch]:
    """Averaged predictive probabilities and training counts of each block's entries in the range."""
    schema = pa.schema([("block", pa.int64()), ("dest", pa.int32()), ("data", pa.list_(pa.binary()))])
    totals = _past(history)
    for batch in batches:
        for row in batch.to_pylist():
            p, n = 0.0, 0
            for number, seating in _seated(row, totals[:-1]):
                if number > burn_in or number == len(totals) - 1:
                    p = p + seating.probabilities(totals[number])[2]
                    n += 1
            p = (p / n).astype(np.float32)
            counts = np.repeat(seating.word_counts, np.diff(np.r_[seating.first1[seating.first0], len(p)]))
            for block, places, check in zip(row["blocks"], row["places"], row["checks"]):
                at = _unpack_ascending(places, np.uint32)
                yield batch_of({"block": [block], "dest": [row["dest"]], "data": [[_pack(p[at]), _pack(counts[at]), _pack(np.array([check]))]]}, schema)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], tokens: int, words: int) -> Iterator[pa.RecordBatch]:
    """Rows by block, its modelled entries by range before its texts."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    now, parts = None, []
    for batch in batches:
        for block, dest, data in zip(*(batch.column(c).to_pylist() for c in ("block", "dest", "data"))):
            if block != now:
                now, parts = block, []
            if dest >= 0:
                parts.append((_unpack(data[0], np.float32), _unpack(data[1], np.int64), _unpack(data[2], np.uint64)))
                continue
            p, c, checks = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 3
            ids, train, n, index, expected = (_unpack(x, t) for x, t in zip(data, (np.int64, bool, np.int32, np.uint32, np.uint64)))
            if not np.array_equal(checks, expected):
                raise RuntimeError("the documents came in another order in the second pass; write them to a table first")
            starts = np.cumsum(n) - n
            sum_of = lambda x: np.add.reduceat(x[index], starts)
            base = np.log10((c + 0.1) / (tokens + 0.1 * (words + 1)))
            out = {
                "doc_id": pa.array(ids, mask=ids == NO_ID), "held_out": ~train, "n_tokens": n.astype(np.int64), "n_known": sum_of((c > 0).astype(np.int64)),
                "train_tokens": np.full(len(ids), tokens, np.int64), "base_score": sum_of(base), "score": sum_of(np.log10(p.astype(np.float64))),
            }
            for at in range(0, len(ids), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name][at : at + 8192], type=f.type) for f in schema], schema=schema)


def score(docs: DataFrame, train, sweeps: int = SWEEPS, burn_in: int = BURN_IN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Counts and log10 probabilities of every row of docs(doc_id, text), learning from those where the condition `train` holds."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select("doc_id", "text", train.alias("train")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "train")
    # The partition's number in the table, whatever the stage that reads it.
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    chars = rows.agg(F.sum(F.length("text") + 1).alias("chars")).first()["chars"] or 0
    ranges = max(4 * n, math.ceil(chars / RANGE_CHARS))
    encode = functools.partial(_encode, ranges=ranges, block_chars=block_chars)
    entries = rows.mapInArrow(functools.partial(encode, texts=False), _ENCODED)
    merged = stored(entries.repartition(max(n, ranges // 4), "dest").sortWithinPartitions("dest", "block").mapInArrow(_merge, _MERGED))
    history, shared = [], []
    for _ in range(sweeps + 1):
        sums = merged.select("dest", "entries", "counts").mapInArrow(functools.partial(_sum_totals, history=list(shared)), _TOTALS)
        # 65 slices and a row of sums: a proven bound.
        found = sums.repartition(min(n, 64), "slice").sortWithinPartitions("slice").mapInArrow(_add, _TOTALS).collect()
        history.append(Totals(found, history[0] if history else None))
        shared.append(spark.sparkContext.broadcast(history[-1]))
    modelled = merged.mapInArrow(functools.partial(_average, history=shared, burn_in=burn_in), _MODELLED)
    dealt = modelled.unionByName(rows.mapInArrow(functools.partial(encode, texts=True), _ENCODED)).withColumn("late", F.col("dest") < 0)
    dealt = dealt.repartition(max(n, math.ceil(chars / block_chars)), "block").sortWithinPartitions("block", "late", "dest")
    return dealt.select("block", "dest", "data").mapInArrow(functools.partial(_score, tokens=history[-1].tokens, words=history[-1].words), _SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) != 0)
