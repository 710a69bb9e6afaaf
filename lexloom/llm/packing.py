"""Best-fit packing by a swap-based local search.

Documents are tokenised where they lie; only (doc_id, piece, length) rows are dealt over the cluster.
A task packs blocks of up to ``block`` pieces: best fit decreasing gives the first bins, then the search
improves bins that are not full.  It fills a target bin from any other one by moving a document, by
exchanging one for one, or two for one, always the step that leaves the least room; every step raises
the sum of squared fills, and the search ends when no step does.  Emptied bins go; bins that are not full
are carried into the next block, the emptiest first and at most ``block`` pieces, so a task's memory is bounded.

Defined cases: null text counts as empty (its piece is the end id alone); repeated rows are packed once
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch_of, kept, small_slices, table, texts_of

CAPACITY = 4096
END_ID = 1
BLOCK = 65_536
#: Parts of texts of a generation kept with their ids in a worker; a full one becomes the old one, whose parts come back as they are met.
CACHE_WORDS = 300_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: Classes of UTF-8 bytes: ASCII letters and the lead bytes of U+00C0 to U+024F, marks but the apostrophe, digits, white space; of all others nothing is told.
LETTER, MARK, DIGIT, SPACE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
for _kind, _bytes in ((LETTER, string.ascii_letters.encode() + bytes(range(0xC3, 0xCA))), (MARK, string.punctuation.replace("'", "").encode()), (DIGIT, string.digits.encode()), (SPACE, b"\t\n\v\f\r ")):
    _CLASS[[*_bytes]] = _kind
#: By the classes before and after a place: whether the tokenizer cuts there, whatever stands around.
_CUTS = np.array([[SPACE in (x, y) and x != y or 0 not in (x, y) and (x != y or x == DIGIT) for y in range(5)] for x in range(5)]).ravel()


def _classes(data: np.ndarray) -> np.ndarray:
    out = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    x, y = data[lead], data[lead + 1]
    # Two signs that are no letters, and the one letter that lower case makes two characters of.
    told = ~(((x == 0xC3) & ((y == 0x97) | (y == 0xB7))) | ((x == 0xC4) & (y == 0xB0)))
    out[lead] = out[lead + 1] = np.where(told, LETTER, 0)
    return out


def _parts(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The texts' parts in turn, and before which part each text starts: cut at white space, which is dropped, and where letters, marks and digits meet."""
    if not len(texts):
        return texts, np.zeros(1, np.int64)
    upto = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    kinds = _classes(data)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = _CUTS[kinds[:-1] * np.uint8(5) + kinds[1:]]
    cut[upto - upto[0]] = True
    at = np.flatnonzero(cut)
    kept = kinds[at[:-1]] != SPACE
    starts, lengths = at[:-1][kept], np.diff(at)[kept]
    data = data[kinds != SPACE]
    # Letter case is no part of an id, but a mark that joins a letter (U+0300 to U+036F) may know only one case, and it joins before letters are lowered.
    if not ((data == 0xCC) | (data == 0xCD)).any():
        data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return parts, np.searchsorted(starts, upto - upto[0])


class WordEncoder:
    """Ids of whole texts.  The tokenizer never merges over white space, nor where its pattern cuts whatever stands around, so a text's ids are its parts' ids in turn."""

    def __init__(self, path: str, end_id: int = END_ID):
        self.tokenizer, self.known, self.old, self.end = _tokenizer(path), {}, {}, struct.pack("<I", end_id)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are one pre-token each: encoded as one text and told apart by the word-end mark of a pre-token's last id."""
        out = {}
        for at in range(0, len(parts), 4096):
            part = parts[at : at + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            out |= zip(part, [raw[s:e] for s, e in zip([0, *cuts], cuts)] if len(cuts) == len(part) else self._ids(part))
        return out

    def _new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts met for the first time."""
        texts = pa.array(parts, pa.large_string())
        upto = np.frombuffer(texts.buffers()[1], np.int64, len(parts) + 1)
        told = np.logical_and.reduceat(_classes(np.frombuffer(texts.buffers()[2], np.uint8)) != 0, upto[:-1]).tolist()
        other = [w for w, x in zip(parts, told) if not x]
        return self._whole([w for w, x in zip(parts, told) if x]) | dict(zip(other, self._ids(other)))

    def _of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = [*map(known.get, parts)]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            w = parts[i]
            if w in old:
                out[i] = known[w] = old[w]
            else:
                new.append(i)
        if new:
            fresh = self._new([parts[i] for i in new])
            known.update((w, x) for w, x in fresh.items() if len(w) <= 64)
            for i in new:
                out[i] = fresh[parts[i]]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and the end id.  Texts are cut and put together in arrays; Python sees each distinct part once a call."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        parts, first = _parts(column)
        found = parts.dictionary_encode()
        ids = pa.array(self._of(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        cuts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first].tolist() if len(ids) else [0] * len(first)
        data = memoryview(ids.buffers()[2] or b"")
        return [b"".join((data[s:e], self.end)) for s, e in zip(cuts, cuts[1:])]


def _encoder(path: str) -> WordEncoder:
    """One for all packing tasks of a worker; other operators' tasks drop it."""
    found = kept("packing", dict)
    if path not in found:
        found[path] = WordEncoder(path)
    return found[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    step = 4 * capacity
    for batch in small_slices(batches, 2_000_000, "packing"):
        rows = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        yield batch_of(dict(zip(_PIECES_ARROW.names, zip(*rows))), _PIECES_ARROW)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token sequences of docs(doc_id, text), cut only beyond capacity."""
    return texts_of(docs).mapInArrow(functools.partial(_cut, path=path, capacity=capacity), _PIECES)


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; each size goes, largest first, to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        fitting = open_rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room_bins[room - s].append(b)
        open_rooms |= 1 << (room - s)
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins that raise the sum of squared fills, until none does.

    An index has, for each size and each sum of two sizes of a bin, the underfull bins that have it by fill.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = {b: list(x) for b, x in enumerate(bins)}
        self.fill = {b: sum(sizes[i] for i in x) for b, x in self.bins.items()}
        # Of one document and of two: the bins by (fill, bin) at each sum, and the sums that some bin has as bits.
        self.having: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.present = [0, 0]
        for b in self.bins:
            self._enter(b)

    def _sums(self, b: int) -> tuple[set[int], set[int]]:
        counts = Counter(self.sizes[i] for i in self.bins[b])
        ones = sorted(counts)
        twos = {x + y for k, x in enumerate(ones) for y in ones[k + 1 :]} | {2 * x for x, n in counts.items() if n > 1}
        return set(ones), twos

    def _enter(self, b: int) -> None:
        if self.fill[b] >= self.capacity:
            return
        for k, sums in enumerate(self._sums(b)):
            for x in sums:
                insort(self.having[k].setdefault(x, []), (self.fill[b], b))
                self.present[k] |= 1 << x

    def _leave(self, b: int) -> None:
        for k, sums in enumerate(self._sums(b)):
            for x in sums:
                held = self.having[k][x]
                del held[bisect_left(held, (self.fill[b], b))]
                if not held:
                    del self.having[k][x]
                    self.present[k] &= ~(1 << x)

    def _exchange(self, into: int, out_of: int, give: list[int], take: list[int]) -> None:
        for b in (into, out_of):
            self._leave(b)
        for i in give:
            self.bins[into].remove(i)
        for i in take:
            self.bins[out_of].remove(i)
        self.bins[into] += take
        self.bins[out_of] += give
        d = sum(self.sizes[i] for i in take) - sum(self.sizes[i] for i in give)
        self.fill[into] += d
        self.fill[out_of] -= d
        for b in (into, out_of):
            if self.bins[b]:
                self._enter(b)
            else:
                del self.bins[b], self.fill[b]

    def _chosen(self, b: int, total: int, n: int) -> list[int]:
        """n documents of the bin whose sizes add up to total."""
        of: dict[int, int] = {}
        for i in self.bins[b]:
            x = self.sizes[i]
            if n == 1 and x == total:
                return [i]
            if n == 2 and total - x in of:
                return [of[total - x], i]
            of.setdefault(x, i)
        return []

    def _step(self, into: int) -> bool:
        """The step that fills `into` most, if any raises the sum of squares; of its givers the emptiest."""
        fill, room = self.fill[into], self.capacity - self.fill[into]
        ones, twos = self._sums(into)
        best = (0, 0, 0, 0, 0)
        for n_give, sums, takes in ((0, (0,), (1,)), (1, ones, (1, 2)), (2, twos, (1,))):
            for give in sums:
                for n_take in takes:
                    found = self.present[n_take - 1] >> (give + 1) & (1 << room) - 1
                    # Gains above the best so far, largest first.
                    while (gain := found.bit_length()) > best[0]:
                        held = self.having[n_take - 1][give + gain]
                        out = held[0] if held[0][1] != into else held[1] if len(held) > 1 else None
                        if out and out[0] < fill + gain:
                            best = (gain, out[1], n_give, give, n_take)
                        found ^= 1 << (gain - 1)
                if best[0] == room:
                    break
        gain, out_of, n_give, give, n_take = best
        if not gain:
            return False
        self._exchange(into, out_of, self._chosen(into, give, n_give) if n_give else [], self._chosen(out_of, give + gain, n_take))
        return True

    def run(self) -> list[list[int]]:
        """Each underfull bin, the emptiest first, takes from others as long as it gains; again until no bin does."""
        changed = True
        while changed:
            changed = False
            for _, b in sorted((f, b) for b, f in self.fill.items() if f < self.capacity):
                while b in self.fill and self.fill[b] < self.capacity and self._step(b):
                    changed = True
        return list(self.bins.values())


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices of sizes, none over capacity."""
    whole = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    small = [sizes[i] for i in rest]
    found = LocalSearch(small, best_fit_decreasing(small, capacity), capacity).run()
    return whole + [[rest[i] for i in b] for b in found]


_PACKED = f"{_PIECES}, sequence_id long, offset long"


def _pack_partition(batches: Iterator[pa.RecordBatch], capacity: int, block: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    base = TaskContext.get().partitionId() << 40
    n_bins, held = 0, None

    def packed(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        nonlocal n_bins
        sizes = rows.column("length").to_pylist()
        seq, offset, keep = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64), []
        bins = sorted(((sum(sizes[i] for i in b), b) for b in pack(sizes, capacity)), key=lambda x: x[0])
        for fill, b in bins:
            if not last and fill < capacity and len(keep) + len(b) <= block:
                keep += b
                continue
            at = 0
            for i in b:
                seq[i], offset[i] = base + n_bins, at
                at += sizes[i]
            n_bins += 1
        done = np.flatnonzero(seq >= 0)
        out = rows.take(pa.array(done)).append_column("sequence_id", pa.array(seq[done])).append_column("offset", pa.array(offset[done]))
        out = out.cast(schema).combine_chunks().to_batches()
        return (out[0] if out else None), (rows.take(pa.array(sorted(keep), pa.int64())) if keep else None)

    waiting: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]).cast(_PIECES_ARROW))
        count += batch.num_rows
        if count >= block:
            out, held = packed(pa.concat_tables(waiting), False)
            waiting, count = ([held] if held else []), 0
            if out:
                yield out
    if waiting:
        out, _ = packed(pa.concat_tables(waiting), True)
        if out:
            yield out


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence and its place there."""
    # No partition count: rows are small, and adaptive execution joins small partitions, which wastes fewer half-filled sequences.
    dealt = pieces(docs, path, capacity).repartition(F.xxhash64("doc_id", "piece"))
    # A fixed order within the partition: a task that runs again packs alike.
    ordered = dealt.sortWithinPartitions(F.xxhash64("ids_crc32", "doc_id"), "doc_id", "piece", "start", "ids_crc32")
    return ordered.mapInArrow(functools.partial(_pack_partition, capacity=capacity, block=block), _PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
