"""Language ID by hierarchical discrimination.

First the language family: one-versus-rest linear support vector machines.  Then, within that family,
one-versus-one linear support vector machines that vote among its languages.  Features are hashed
character bigrams and trigrams of the whole lower-cased text (what is not a letter counts as one
separator), as shares of the text's length, so a machine's output is a mean of weights: it is summed in
numpy over all positions, with no feature matrix.

The machines learn from a bounded, documented sample (at most about ``per_language`` labelled texts of
each language, chosen by a hash of the id); the model has a fixed size and is broadcast.

Defined cases: null text or one without a letter is ``und`` with score 0; null ids and labels are never
learned from; repeated rows are predicted each; without any labelled text all are ``und``; extra columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, id_remainder, small_slices, table

UND = "und"
BUCKETS = 1 << 13
PER_LANGUAGE = 500
#: Learned languages at most share this many sampled texts.
SAMPLE = 4_000
#: Families of common languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("yue", "zh"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.split("-")[0], lang)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letter of each code point, 0 for what is not a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(len(out)):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts, 0 elsewhere, each text between a 0 of its own on either side; and where the first of these is."""
    code = np.frombuffer(("\0" + "\0\0".join(texts) + "\0\0\0").encode("utf-32-le", "replace"), np.uint32)
    lower = _letters()[code]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return lower, np.cumsum(lengths) - lengths


def grams(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the bigram and of the trigram at each position; and whether they count: two separators first don't, so no text sees the next one."""
    a, b, c = lower[:-2], lower[1:-1], lower[2:]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two * np.uint32(0x27D4EB2F) + c * np.uint32(0xC2B2AE3D) + np.uint32(1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, (a | b) != 0


def features(texts: list[str]) -> np.ndarray:
    """Dense rows of BUCKETS shares."""
    lower, starts = letters(texts)
    two, three, counted = grams(lower)
    ends = np.r_[starts[1:], len(two)]
    rows = np.zeros((len(texts), BUCKETS), np.float32)
    for i, (s, e) in enumerate(zip(starts, ends)):
        on = counted[s:e]
        rows[i] = np.bincount(two[s:e][on], minlength=BUCKETS) + np.bincount(three[s:e][on], minlength=BUCKETS)
        rows[i] /= max(1, e - s)
    return rows


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope (of the margin's logistic calibration) of a linear SVM: averaged stochastic subgradients of the squared hinge loss; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    mean_w, mean_b, n = np.zeros_like(w), 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    scale = 1.0 / max(1e-12, float((x**2).sum(axis=1).mean()))
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            slack = np.maximum(0, 1 - y[rows] * (x[rows] @ w + b)) * y[rows] * weight[rows] / len(rows)
            rate = scale / (1 + epoch / 4)
            w = w * (1 - 1e-5) + rate * (slack @ x[rows])
            b += 0.1 * slack.sum()
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
                n += 1
    w, b = mean_w / n, mean_b / n
    margin = y * (x @ w + b)
    slope = 1.0
    for _ in range(20):  # Newton steps for the slope, held back by a prior at 4
        p = 1 / (1 + np.exp(np.clip(slope * margin, -30, 30)))
        grad, curve = (p * margin).mean() - 0.02 * (slope - 4), (p * (1 - p) * margin**2).mean() + 0.02
        slope = float(np.clip(slope + grad / curve, 0.5, 20))
    return w.astype(np.float32), float(b), slope


class Model:
    """Machines of the families and of the pairs within them."""

    def __init__(self, langs: list[str], x: np.ndarray, of: np.ndarray):
        """of: index into langs of each row of x."""
        self.langs = langs
        self.families = sorted({family_of(x) for x in langs})
        family = np.array([self.families.index(family_of(lang)) for lang in langs] or [0])
        self.members = [[i for i in range(len(langs)) if family[i] == f] for f in range(len(self.families))]
        machines, self.pairs = [], []
        if len(self.families) > 1:
            machines = [svm(x, np.where(family[of] == f, 1.0, -1.0)) for f in range(len(self.families))]
        for f, members in enumerate(self.members):
            for i, j in combinations(members, 2):
                rows = (of == i) | (of == j)
                self.pairs.append((f, i, j, len(machines)))
                machines.append(svm(x[rows], np.where(of[rows] == i, 1.0, -1.0)))
        self.w = np.ascontiguousarray(np.array([m[0] for m in machines]).T.reshape(BUCKETS, len(machines)))
        self.b = np.array([m[1] for m in machines])
        self.slope = np.array([m[2] for m in machines])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        out, score = [UND] * len(texts), np.zeros(len(texts))
        if not texts or not self.langs:
            return out, score
        lower, starts = letters(texts)
        ends = np.r_[starts[1:], len(lower) - 2]
        spoken = np.add.reduceat((lower != 0).astype(np.int32), starts) > 0
        z = np.zeros((len(texts), self.w.shape[1]))
        if self.w.shape[1]:
            two, three, counted = grams(lower)
            for k in range(self.w.shape[1]):
                w = np.ascontiguousarray(self.w[:, k])
                z[:, k] = np.add.reduceat((w[two] + w[three]) * counted, starts, dtype=np.float64)
            z = z / np.maximum(1, ends - starts)[:, None] + self.b
        p = 1 / (1 + np.exp(-np.clip(z * self.slope, -30, 30)))
        if len(self.families) > 1:
            of_family = p[:, : len(self.families)]
            chosen = of_family.argmax(axis=1)
            sure = of_family.max(axis=1) / np.maximum(1e-12, of_family.sum(axis=1))
        else:
            chosen, sure = np.zeros(len(texts), np.int64), np.ones(len(texts))
        votes, mean = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        for _, i, j, k in self.pairs:
            votes[:, i] += z[:, k] >= 0
            votes[:, j] += z[:, k] < 0
            mean[:, i] += p[:, k]
            mean[:, j] += 1 - p[:, k]
        for t in np.flatnonzero(spoken):
            members = self.members[chosen[t]]
            best = max(members, key=lambda i: (votes[t, i], mean[t, i], -i))
            out[t] = self.langs[best]
            score[t] = sure[t] * (mean[t, best] / (len(members) - 1) if len(members) > 1 else 1.0)
        return out, score


def learn(docs: DataFrame, allowed, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model of docs(doc_id, text, lang) where the condition `allowed` holds.

    Two passes: counts by language (ids and labels only), then the texts of about per_language rows of
    each, by a hash below a threshold.  Their feature rows, not the texts, come to the driver.  The sample's
    bound also bounds the languages: the commonest ``sample // 4`` (1,000) are learned.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample // 4).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))
    each = min(per_language, sample // len(langs))
    # By row, not by id: one id may have any number of rows.
    share = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), 1_000_000) / 1_000_000.0
    limit = functools.reduce(lambda c, x: c.when(F.col("lang") == x, F.lit(each / counts[x])), langs, F.when(F.lit(False), 0.0))
    rows = known.withColumn("_share", share).where(F.col("_share") < limit).select("lang", "text").mapInArrow(_feature_rows, "lang string, at binary, value binary").collect()
    x, of = np.zeros((len(rows), BUCKETS), np.float32), np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
        of[i] = langs.index(r["lang"])
    present = sorted(set(of.tolist()))
    return Model([langs[i] for i in present], x, np.searchsorted(present, of))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())])
    for batch in small_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            row = features([text or ""])[0]
            at = np.flatnonzero(row)
            if len(at) and any(map(str.isalpha, text)):
                yield batch_of({"lang": [lang], "at": [at.astype(np.uint16).tobytes()], "value": [row[at].tobytes()]}, schema)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    for batch in small_slices(batches, 2_000_000):
        langs, score = model.value.predict([t or "" for t in batch.column("text").to_pylist()])
        yield batch_of({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": score}, schema)


def predict_column(model):
    """A column function: struct<lang_pred, score> of a text column, for a broadcast model."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        for texts in batches:
            rows = []
            for b in small_slices(iter([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])]), 2_000_000):
                langs, score = model.value.predict([t or "" for t in b.column("text").to_pylist()])
                rows += [{"lang_pred": a, "score": s} for a, s in zip(langs, score.tolist())]
            yield pa.array(rows, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(functools.partial(_predict, model=shared), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_remainder("doc_id", 3) == 1
    return identify(docs, learn(docs, ~held), held)
