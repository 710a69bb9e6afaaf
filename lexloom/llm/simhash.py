"""SimHash near-duplicates found in BK-trees.

A fingerprint has 64 bits of word shingles, or several such words of independent hashes.  Distinct
fingerprints are dealt over shards, and a shard is a BK-tree: children keyed by the integer Hamming
distance to their parent, a query following only edges within the radius of its own distance.

Exact links (``near_duplicates`` with one word): two fingerprints that differ in at most ``radius`` bits agree
on one of radius + 1 blocks of bits, so each fingerprint is in a shard for each block, by its value, and
no link is lost.  Links by similarity (``similar_documents``): fingerprints of eight words, of the distinct
shingles, only find candidates: the radius is wide enough for every pair of texts of that similarity, and the
shards are bands of minima of the shingles' hashes, which such texts share (all but two in ten thousand at 0.8
itself).  Texts of each component of candidates meet once more, and a candidate links only if the exact
Jaccard similarity of the two shingle sets (as 64-bit hashes) reaches the bound.

A shard of over ``shard_rows`` fingerprints becomes several trees of about that size, to each of which all of
the shard's fingerprints are sent, so one crowded value never meets in one task.  Trees report spanning
links, not all pairs; components come from alternating star contractions over these links.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are kept;
a null doc_id is no component's smallest id unless the whole component has none (then component_id is null);
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, lower_ascii, partitions, popcount, small_slices, stored, table, texts_of

SHINGLE = 3
RADIUS = 3
#: Words of a shingle, similarity and 64-bit words of a fingerprint where no contract says otherwise.
SHINGLE_NEAR, SIMILARITY, WORDS_NEAR = 5, 0.8, 8
#: Bands of minima, and minima in a band.
BANDS, BAND_ROWS = 12, 3
SHARD_ROWS = 16_384
#: Deviations added to the expected differing bits, rows and shingles of candidates held at a time.
DEVIATIONS = 6
CHECK_ROWS, CHECK_SHINGLES = 5_000, 2_000_000
#: Query-node pairs that a tree walk holds at a time, and rows of shards joined into one walk.
FRONTIER = 50_000
WALK_ROWS = 200_000

#: Ones of each byte's bits, low bit first.
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ODD = np.random.default_rng(9).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    words = lower_ascii(text).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = [*accumulate(map(len, words), lambda a, n: a + 1 + n)]
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    n = len(starts)
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[s:e] for s, e in zip(starts, ends[size - 1 :])], repeat(42)), np.uint64, n)


def remixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes themselves, then independent mixtures of them."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        x = (hashes ^ (hashes >> np.uint64(29))) * _ODD[k]
        x = (x ^ (x >> np.uint64(32))) * _ODD[k + 16]
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """`words` unsigned words; a bit is set if over half of the hashes have it."""
    counts = np.zeros((8 * words, 8), np.int64)
    place = np.arange(8 * words) * 256
    for at in range(0, len(hashes), 50_000):
        part = remixed(hashes[at : at + 50_000], words)
        # Counts of each byte's values, then of its bits.
        values = np.bincount((part.view(np.uint8).reshape(len(part), -1) + place).ravel(), minlength=2048 * words)
        counts += values.reshape(-1, 256) @ _BITS_OF
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").ravel().view("<u8")


def block_shards(fp: int, radius: int) -> list[int]:
    """One shard for each of radius + 1 blocks of a 64-bit fingerprint: the block's number and its bits."""
    width = 64 // (radius + 1)
    widths = [width] * radius + [64 - width * radius]
    out, at = [], 0
    for k, w in enumerate(widths):
        out.append(((fp >> at & (1 << w) - 1) << 4 | k) & (1 << 63) - 1)
        at += w
    return out


def band_shards(hashes: np.ndarray) -> list[int]:
    """One shard for each band of minima of remixed hashes; one for all texts without words."""
    if not len(hashes):
        return [0]
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000]
        part = part ^ (part >> np.uint64(31))
        for k in range(len(least)):
            x = part * _ODD[k]
            least[k] = min(least[k], (x ^ (x >> np.uint64(32))).min())
    bands = least.reshape(BANDS, BAND_ROWS).astype("<u8")
    return [xxhash.xxh64_intdigest(b.tobytes(), k) >> 1 for k, b in enumerate(bands)]


def shingle_set(text: str, size: int = SHINGLE_NEAR) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(text, size))


_PRINTS = "doc_id long, id long, fp binary, shards array<long>"
_SET_PRINTS = "doc_id long, row long, id long, fp binary, shards array<long>"


def _set_fingerprints(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of shingle sets; the id stands for the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("fp", pa.binary()), ("shards", pa.list_(pa.int64()))])
    for batch in small_slices(batches):
        sets = [shingle_set(text, size) for text in batch.column("text").to_pylist()]
        ids = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        yield batch_of({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "id": ids, "fp": [fingerprint(x, words).tobytes() for x in sets], "shards": [band_shards(x) for x in sets]}, schema)


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, radius: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("fp", pa.binary()), ("shards", pa.list_(pa.int64()))])
    for batch in small_slices(batches):
        fps, shards = [], []
        for text in batch.column("text").to_pylist():
            hashes = shingle_hashes(text, size)
            fps.append(fingerprint(hashes))
            shards.append(block_shards(int(fps[-1][0]), radius))
        ids = np.array([f[0] for f in fps], np.uint64).view(np.int64)
        yield batch_of({"doc_id": batch.column("doc_id"), "id": ids, "fp": [f.tobytes() for f in fps], "shards": shards}, schema)


def fingerprints(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, id (the fingerprint's bits), fp, shards by blocks."""
    return texts_of(docs).mapInArrow(functools.partial(_fingerprints, size=size, radius=radius), _PRINTS)


def _differing(both: int, one: int, other: int) -> float:
    """Probability that a bit differs between sets with so many shingles in common and of their own."""
    ways = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    a, b, c = ways(both), ways(one), ways(other)
    n, m = both + one, both + other
    out = 0.0
    for k in range(both + 1):
        p = b[2 * (k + np.arange(one + 1)) > n].sum()
        q = c[2 * (k + np.arange(other + 1)) > m].sum()
        out += a[k] * (p * (1 - q) + q * (1 - p))
    return float(out)


@functools.lru_cache(maxsize=8)
def radius_of(similarity: float, words: int) -> int:
    """Differing bits that no two sets of this Jaccard similarity exceed: the most expected of any sizes (few shingles differ in more bits than many), and DEVIATIONS more."""
    bits = 64 * words
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for both in range(1, 61):
        own = math.floor(both / similarity - both + 1e-9)
        share = max(share, *(_differing(both, x, n - x) for n in range(own + 1) for x in range(n // 2 + 1)))
    return min(bits, math.floor(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return popcount(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees of many groups, built and walked level by level for all groups at once."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """fp: (n, words) of uint64; group: not negative, ascending."""
        self.fp = fp
        self.scale = 64 * fp.shape[1] + 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(fp) else np.zeros(0, np.int64)
        self.groups, self.roots = group[first], first
        at = first[np.searchsorted(self.groups, group)]  # the node that an item stands at
        active = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        keys, children = [], []
        while len(active):
            edge = at[active] * self.scale + distance(fp[active], fp[at[active]])
            found, lead, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(active[lead])
            at[active] = active[lead][inverse]
            active = np.delete(active, lead)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)
        parent, self.edge = np.divmod(keys[order], self.scale)
        self.begin = np.searchsorted(parent, np.arange(len(fp) + 1))

    def near(self, fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (query, item) with a distance of radius or less in the query's group."""
        if not len(self.groups):
            return
        at = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        q = np.flatnonzero(self.groups[at] == group)
        stack = [(q, self.roots[at[q]])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack.append((q[FRONTIER:], node[FRONTIER:]))
                q, node = q[:FRONTIER], node[:FRONTIER]
            d = distance(fp[q], self.fp[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = self.begin[node]
            n = self.begin[node + 1] - lo
            total = int(n.sum())
            if total:
                child = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
                on = np.abs(self.edge[child] - np.repeat(d, n)) <= radius
                stack.append((np.repeat(q, n)[on], self.children[child[on]]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] for all i; label[x] is a smaller or equal member of x's set, roots name themselves."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort(-low, kind="stable")
        label[high[order]] = low[order]
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have this Jaccard similarity at least; empty sets are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _links_of(group: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, smaller index) of the rows' groups; with sets, of pairs that are similar."""
    items = np.flatnonzero(in_tree)
    forest = BKForest(fp[items], group[items])
    label = np.arange(len(fp))
    for q, node in forest.near(fp, group, radius):
        node = items[node]
        if sets is None:
            unite(label, q, node)
            continue
        # Two tree rows find one another; one look is enough.
        on = ~in_tree[q] | (q > node)
        q, node = q[on], node[on]
        # Of each query one pair at a time: what is joined by then needs no look.
        while (apart := label[q] != label[node]).any():
            q, node = q[apart], node[apart]
            lead = np.unique(q, return_index=True)[1]
            right = lead[[similar(sets[i], sets[j], similarity) for i, j in zip(q[lead].tolist(), node[lead].tolist())]]
            unite(label, q[right], node[right])
            q, node = np.delete(q, lead), np.delete(node, lead)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def _walk(batches: Iterator[pa.RecordBatch], radius: int, words: int, size: int = 0, similarity: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, id, fp, in_tree; for a similarity also text) come by shard and part, a tree's own rows first."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, words), np.uint64), np.zeros(0, object)]

    def walked(rows: list[np.ndarray]) -> pa.RecordBatch:
        shard, part, ids, in_tree, fp, sets = rows
        group = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]) if len(fp) else np.zeros(0, np.int64)
        a, b = _links_of(group, fp, in_tree, radius, sets if similarity else None, similarity)
        return batch_of({"a": np.maximum(ids[a], ids[b]), "b": np.minimum(ids[a], ids[b])}, schema)

    for batch in small_slices(batches, CHECK_SHINGLES) if similarity else batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "id", "in_tree")]
        fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, words)
        sets = np.empty(batch.num_rows, object)
        if similarity:
            sets[:] = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
        held = [np.concatenate([x, y]) for x, y in zip(held, [*new, fp, sets])]
        if len(held[0]) < (CHECK_ROWS if similarity else WALK_ROWS) and not (similarity and sum(map(len, held[5])) >= CHECK_SHINGLES):
            continue
        # The last group may go on: its tree's rows stay; if only tree rows have come, it waits as a whole.
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        if held[3][-1]:
            yield walked([x[~last] for x in held])
            held = [x[last] for x in held]
        else:
            yield walked(held)
            held = [x[last & held[3]] for x in held]
    if len(held[0]):
        yield walked(held)


def links(prints: DataFrame, radius: int, words: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links a > b between the ids of prints(id, fp, shards), each fingerprint once, that share a shard and differ in at most radius bits."""
    keyed = prints.select("id", "fp", F.explode("shards").alias("shard"))
    # A shard of one fingerprint links nothing; counts come from ids and shards alone.
    sizes = prints.select(F.explode("shards").alias("shard")).groupBy("shard").count().where("count > 1")
    return _dealt(keyed, sizes, shard_rows).mapInArrow(functools.partial(_walk, radius=radius, words=words), "a long, b long")


def _dealt(keyed: DataFrame, sizes: DataFrame, shard_rows: int, *more: str) -> DataFrame:
    """keyed(shard, id, fp) as trees' rows and queries; sizes: shard, count."""
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return (
        keyed.join(sizes, "shard")
        .withColumn("parts", F.ceil(F.col("count") / shard_rows).cast("int"))
        .select("shard", "id", "fp", *more, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .select("shard", F.col("part").cast("long").alias("part"), "id", "fp", (F.col("own") == F.col("part")).alias("in_tree"), *more)
        .repartition(partitions(keyed.sparkSession), "shard", "part")
        .sortWithinPartitions("shard", "part", F.col("in_tree").desc(), "id")
    )


def similar_links(candidates: DataFrame, size: int, similarity: float, words: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning links a > b of candidates(id, fp, text, shard) of one shard whose shingle sets have this similarity."""
    sizes = candidates.groupBy("shard").count()
    walk = functools.partial(_walk, radius=radius_of(similarity, words), words=words, size=size, similarity=similarity)
    return _dealt(candidates, sizes, shard_rows, "text").mapInArrow(walk, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of pairs(a, b): the smallest node that it reaches.  Alternating large and small stars until nothing changes."""

    def summary(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return row["n"], row["h"]

    edges = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = summary(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = stored(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        if (now := summary(edges)) == before:
            break
        before = now
    members = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _labelled(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """doc_id, id, component_id of every row of prints; rooted: id, least (smallest doc_id), root."""
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # The hot side of the last join is prints, whose large partitions adaptive execution splits.
    by_print = stored(rooted.select("id", "root").join(smallest, "root").select("id", "component_id"))
    return prints.select("doc_id", "id").join(by_print, "id")


def _rooted(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """distinct(id, least) with the root of each id's component; found: (node, root) of those that link."""
    return distinct.select("id", "least").join(found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _one() -> Column:
    """One row for each fingerprint before anything is dealt: copies, however many, are one."""
    return F.min_by(F.struct("fp", "shards"), F.hash("shards")).alias("one")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, id (the 64-bit fingerprint), component_id of every row: fingerprints link at radius or fewer differing bits."""
    prints = stored(fingerprints(docs, size, radius))
    distinct = stored(prints.groupBy("id").agg(F.min("doc_id").alias("least"), _one()))
    found = components(links(distinct.select("id", "one.fp", "one.shards"), radius, 1, shard_rows))
    return _labelled(prints, _rooted(distinct, found))


def _similar(docs: DataFrame, size: int, similarity: float, words: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Prints of every row, and of each shingle set its id, its first row (none, doc_id, row) and its component's root."""
    texts = texts_of(docs.withColumn("row", row_key()), "row")
    prints = stored(texts.mapInArrow(functools.partial(_set_fingerprints, size=size, words=words), _SET_PRINTS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    distinct = stored(prints.groupBy("id").agg(first, _one()))
    rough = components(links(distinct.select("id", "one.fp", "one.shards"), radius_of(similarity, words), words, shard_rows))
    rough = rough.select(F.col("node").alias("id"), F.col("root").alias("shard"))
    wanted = distinct.select("id", "one.fp", "least.row").join(rough, "id")
    # Rows that repeat id and text share a row key; one text of each set is enough.
    candidates = stored(texts.select("row", "text").join(wanted, "row").dropDuplicates(["id"]).select("id", "fp", "shard", "text"))
    return prints, stored(_rooted(distinct, components(similar_links(candidates, size, similarity, words, shard_rows))))


def row_key() -> Column:
    """Tells rows apart that share a doc_id but not the text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def similar_documents(docs: DataFrame, size: int = SHINGLE_NEAR, similarity: float = SIMILARITY, words: int = WORDS_NEAR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, id, component_id of every row: texts link whose shingle sets have this Jaccard similarity or more."""
    prints, rooted = _similar(docs, size, similarity, words, shard_rows)
    return _labelled(prints, rooted.withColumn("least", F.col("least.doc_id")))


def representatives(docs: DataFrame, size: int = SHINGLE_NEAR, similarity: float = SIMILARITY, words: int = WORDS_NEAR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """row (see row_key) of one row of each component of similar texts: the smallest doc_id's, a null id's if there is no other."""
    _, rooted = _similar(docs, size, similarity, words, shard_rows)
    return rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id")
