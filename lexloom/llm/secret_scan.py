"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns (assignments, access keys, long hex) give the base findings.  Every run of 16 or more
secret-like characters is a candidate, and so is every base finding: the network, in plain numpy, sees its
characters and the context on either side (of a long run, in windows that overlap).  Of a run that base
findings touch, the parts that they leave are candidates of their own.  Candidates whose calibrated
probability reaches the threshold are added; base findings stay, and how many of them the network would
have found is counted.  The network learns from labelled findings that a seeded generator writes, without
a look at the data (credentials of many forms; numbers, words of many shapes, names, paths, addresses,
versions and dates as harmless ones); its output is calibrated on a part that was held back, and its
threshold is the highest that keeps the recall asked for there.

Defined cases: null text counts as empty and has no findings; very long texts are scanned whole; repeated
rows are scanned each; extra columns are ignored (redaction keeps all columns).
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, small_slices, table, texts_of

#: The base patterns, their kinds in order, and the lengths that a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "network")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
LEAST = 16
_PART = re.compile(r"[A-Za-z0-9+_.-]{16,}")
_ALNUM, _DIGIT, _LETTER = re.compile("[0-9A-Za-z]"), re.compile("[0-9]"), re.compile("[A-Za-z]")
BEFORE, INSIDE, AFTER = 24, 48, 8
REACH = 5
SYMBOLS = 40
RECALL = 0.995

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind as listed; ends exclusive."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Every run of 16 or more secret-like characters that holds a letter or a digit; of a run that base findings touch, the parts that they leave."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, parts, end = m.start(), [], m.end()
        while k < len(base) and base[k][2] <= at:
            k += 1
        for _, s, e in base[k:]:
            if s >= end:
                break
            parts.append((at, s))
            at = max(at, e)
        out += [(s, e) for s, e in [*parts, (at, end)] if e - s >= LEAST and _ALNUM.search(text, s, e)]
    return out


def looks(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What the network sees of a candidate: all of it; of one longer than INSIDE also overlapping windows, and its parts between slashes or equals signs."""
    out = [(start, end)]
    if end - start > INSIDE:
        out += [(s, s + INSIDE) for s in (*range(start, end - INSIDE, INSIDE // 2), end - INSIDE)]
        for m in _PART.finditer(text, start, end):
            if m.end() - m.start() < end - start and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
                out.append(m.span())
    return out


_SYMBOL = np.full(256, 1, np.uint8)
for _i, _c in enumerate(string.ascii_lowercase):
    _SYMBOL[ord(_c)] = 2 + _i % 13  # letters share classes; digits and marks have their own
    _SYMBOL[ord(_c.upper())] = 15 + _i % 7
for _i, _c in enumerate(string.digits):
    _SYMBOL[ord(_c)] = 22 + _i % 4
for _i, _c in enumerate("=:\"'.-_/+@ \n,"):
    _SYMBOL[ord(_c)] = 26 + _i
for _c in "abcdef":
    _SYMBOL[ord(_c)] = 39


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of the context before, of the candidate (a longer one's first and last halves) and of the context after; 0 pads."""
    run = text[start:end]
    if len(run) > INSIDE:
        run = run[: INSIDE // 2] + run[-(INSIDE // 2) :]
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), run.ljust(INSIDE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    raw = np.frombuffer("".join(parts).encode("latin-1", "replace"), np.uint8)
    return np.where(raw == 0, 0, _SYMBOL[raw])


class Network:
    """Embedding, one convolution with ReLU, maximum and mean over the candidate and over the context, a hidden layer, one output."""

    def __init__(self, seed: int = 11, embed: int = 10, filters: int = 24, hidden: int = 24):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, (1 / shape[0]) ** 0.5, shape)
        self.p = {
            "embed": rng.normal(0, 0.5, (SYMBOLS, embed)), "conv": draw(REACH * embed, filters), "conv_b": np.zeros(filters),
            "dense": draw(3 * filters, hidden), "dense_b": np.zeros(hidden), "out": draw(hidden, 1), "out_b": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> dict:
        p = self.p
        n, length = x.shape
        steps = length - REACH + 1
        e = p["embed"][x]
        cols = np.concatenate([e[:, k : k + steps] for k in range(REACH)], axis=2)
        a = np.maximum(0, cols @ p["conv"] + p["conv_b"])
        core = a[:, BEFORE - REACH + 1 : BEFORE + INSIDE]
        top = core.argmax(axis=1)
        outside = a[:, :BEFORE]
        out_top = outside.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(core, top[:, None], 1)[:, 0], core.mean(axis=1), np.take_along_axis(outside, out_top[:, None], 1)[:, 0]], axis=1)
        h = np.maximum(0, pooled @ p["dense"] + p["dense_b"])
        return {"x": x, "cols": cols, "a": a, "core": core, "top": top, "out_top": out_top, "pooled": pooled, "h": h, "z": (h @ p["out"] + p["out_b"])[:, 0]}

    def _gradients(self, f: dict, dz: np.ndarray) -> dict:
        p, g = self.p, {}
        dz = dz[:, None]
        g["out"], g["out_b"] = f["h"].T @ dz, dz.sum(axis=0)
        dh = dz @ p["out"].T * (f["h"] > 0)
        g["dense"], g["dense_b"] = f["pooled"].T @ dh, dh.sum(axis=0)
        d_max, d_mean, d_out = np.split(dh @ p["dense"].T, 3, axis=1)
        da = np.zeros_like(f["a"])
        lo, n_core = BEFORE - REACH + 1, f["core"].shape[1]
        da[:, lo : BEFORE + INSIDE] += d_mean[:, None] / n_core
        rows, cols = np.arange(len(dz))[:, None], np.arange(d_max.shape[1])[None]
        np.add.at(da, (rows, lo + f["top"], cols), d_max)
        np.add.at(da, (rows, f["out_top"], cols), d_out)
        da *= f["a"] > 0
        flat = da.reshape(-1, da.shape[2])
        g["conv"], g["conv_b"] = f["cols"].reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        d_cols = da @ p["conv"].T
        g["embed"] = np.zeros_like(p["embed"])
        width, steps = p["embed"].shape[1], da.shape[1]
        for k in range(REACH):
            np.add.at(g["embed"], f["x"][:, k : k + steps], d_cols[:, :, k * width : (k + 1) * width])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, seed: int = 5, rate: float = 0.004) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                f = self._forward(x[rows])
                g = self._gradients(f, (1 / (1 + np.exp(-f["z"])) - y[rows]) / len(rows))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt's slope and shift, then the highest threshold whose recall on these rows is `recall`."""
        z = self._forward(x)["z"]
        w = np.array([1.0, 0.0])
        rows = np.c_[z, np.ones(len(z))]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            hess = (rows * (p * (1 - p))[:, None]).T @ rows / len(z) + 1e-4 * np.eye(2)
            w = w + np.linalg.solve(hess, rows.T @ (y - p) / len(z) - 1e-4 * (w - [1, 0]))
        self.slope, self.shift = float(w[0]), float(w[1])
        right = np.sort(self.probability(x)[y == 1])
        self.threshold = float(right[int((1 - recall) * len(right))]) if len(right) else 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self._forward(x[i : i + 512])["z"] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n generated (text, start, end) and whether each is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), int(k)))
    any_of = lambda xs: xs[int(rng.integers(len(xs)))]
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    onsets = (*"bcdfghjklmnprstvwz", *"bcdfghlmnprst", "br", "ch", "cl", "dr", "fl", "gr", "ph", "pl", "pr", "qu", "sch", "sh", "sl", "sp", "st", "str", "th", "tr", "wh", "")
    vowels = (*"aeiou", *"aeio", "ai", "ea", "ei", "ie", "io", "oo", "ou", "ue", "y")
    codas = ("", "", "", "", "l", "m", "n", "r", "s", "t", "ch", "ck", "ll", "nd", "ng", "nt", "rt", "ss", "st", "th")
    syllable = lambda: any_of(onsets) + any_of(vowels) + any_of(codas)
    word = lambda a=1, b=5: "".join(syllable() for _ in range(int(rng.integers(a, b))))
    prose = lambda k: " ".join(word() + any_of(("", "", "", ",", ".")) for _ in range(k))
    secrets = (
        lambda: pick(low + up + dig, rng.integers(20, 48)),
        lambda: pick(low + up + dig + "+/", rng.integers(24, 64)) + any_of(("", "=", "==")),
        lambda: pick(hexa, rng.integers(20, 32)),
        lambda: any_of(("sk_live_", "sk-", "rk_live_", "pk_", "key-", "tok_", "pat_")) + pick(low + up + dig, rng.integers(16, 40)),
        lambda: any_of(("ghp_", "gho_", "glpat-", "xoxb-", "npm_", "hf_", "dop_v1_")) + pick(low + up + dig, rng.integers(20, 40)),
        lambda: "eyJ" + pick(low + up + dig, 24) + ".eyJ" + pick(low + up + dig, 30) + "." + pick(low + up + dig + "-_", 32),
        lambda: "AIza" + pick(low + up + dig + "-_", 35),
        lambda: "ASIA" + pick(up + dig, 16),
        lambda: "-".join(pick(up + dig, 5) for _ in range(5)),
    )
    harmless = (
        lambda: pick("45", 1) + pick(dig, 15) + any_of(("", "", "x", "th")),
        lambda: "mail" + pick(dig, 1) + "." + any_of(("example", "sample")) + "." + any_of(("com", "org", "net")) + any_of(("", ".", "/index")),
        lambda: word(2, 4) + "." + pick(dig, 2) + word(2, 4) + "." + any_of(("com", "org", "de")),
        lambda: any_of(("DE", "FR", "ES", "GB")) + pick(dig, rng.integers(18, 22)),
        lambda: f"20{pick(dig, 2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}.{pick(dig, 2)}",
        lambda: "v" + ".".join(str(rng.integers(0, 20)) for _ in range(4)) + "-" + word(2, 5),
        lambda: word(4, 7) + pick(dig, rng.integers(1, 3)),
        lambda: word(5, 10),
        lambda: word(5, 9).capitalize(),
        lambda: word(5, 9).upper(),
        lambda: word(3, 6).upper() + pick(string.ascii_uppercase, 3),
        lambda: word(5, 12),
        lambda: any_of(("", "www.", "mx" + pick(dig, 1) + ".", word(1, 3) + pick(dig, rng.integers(0, 3)) + ".")) + word(2, 5) + any_of(("", "-" + word(1, 3), pick(dig, 1))) + "." + any_of(("com", "org", "net", "io", "de", "co.uk", "info")),
        lambda: word(1, 3) + any_of((".", "_", "")) + word(1, 4) + pick(dig, rng.integers(0, 4)) + "." + word(2, 4) + "." + any_of(("com", "org", "net", "fr", "es")),
        lambda: any_of(("-", "_", ".", "--", "...", "/")).join(word(2, 4) for _ in range(4)),
        lambda: any_of(("-", "_", ".", "/")).join(word(2, 4).capitalize() for _ in range(4)),
        lambda: "_".join(word(2, 3) for _ in range(4)).upper(),
        lambda: word(1, 3) + "".join(word(1, 3).capitalize() for _ in range(4)),
        lambda: pick(dig, rng.integers(16, 32)),
        lambda: "+" + pick(dig, 2) + "-" + "-".join(pick(dig, int(rng.integers(3, 6))) for _ in range(4)),
        lambda: any_of("=-_.") * int(rng.integers(16, 60)) + any_of(("", "", word(1, 2))),
        lambda: "/".join(word(1, 3) for _ in range(4)) + pick(dig, 1) + ".html",
        lambda: word(3, 5) + "-" + pick(dig, rng.integers(1, 5)) + "-" + word(2, 4),
        lambda: "=" * 12 + pick(dig, 3) + "a" + "=" * 6,
        lambda: "-" * int(rng.integers(8, 20)) + word(1, 3) + pick(dig, 1),
        lambda: "...".join(word(1, 3) for _ in range(4)) + pick(dig, 1),
        lambda: ".".join(pick(dig, 3) for _ in range(5)) + any_of(("a", "b", "km")),
        lambda: "_".join(word(1, 3) for _ in range(4)) + "_" + pick(dig, 2),
        lambda: "/".join(word(1, 3) for _ in range(int(rng.integers(8, 16)))) + f"/20{pick(dig, 2)}/{word(1, 3)}-{word(1, 3)}-{pick(dig, 2)}.html",
        lambda: "//" + word(2, 4) + ".org/" + "/".join(word(1, 3) + any_of(("", "", "-" + word(1, 3), "_" + pick(dig, 2))) for _ in range(int(rng.integers(6, 12)))),
    )
    leads = ("key: ", "Authorization: Bearer ", "credential=", "auth ", "client ", 'pwd="', "private ", "use ", "", "", "", "")
    others = (
        lambda: word(1, 3) + any_of((".", "_", "")) + word(1, 3) + pick(dig, rng.integers(0, 4)) + "@",
        lambda: any_of(("http:", "https:", "file ", "see ", "(", "#", "tel: ", "page ", "no. ")),
    )
    rows, y = [], np.zeros(n)
    for i in range(n):
        y[i] = rng.random() < 0.5
        run = any_of(secrets if y[i] else harmless)()
        while len(run) < 16 or y[i] and not (_DIGIT.search(run) and _LETTER.search(run)):
            run += pick(dig + hexa, 4) if y[i] else word(1, 3)
        before = prose(4) + " " + (any_of(leads) if y[i] or rng.random() < 0.1 else any_of(others)() if rng.random() < 0.3 else "")
        if not CANDIDATE.match(before[-1:] + run) and before[-1:] in "=":
            before += '"'
        rows.append((before + run + any_of((" ", "\n", '" ', ", ")) + prose(2), len(before), len(before) + len(run)))
    return rows, y


@functools.lru_cache(maxsize=2)
def trained(n: int = 6_000, recall: float = RECALL) -> Network:
    rows, y = labelled_findings(n, seed=1)
    x = np.array([window(*r) for r in rows])
    network, cut = Network(), n * 3 // 4
    # Of long harmless runs every look is harmless.
    more = np.array([window(r[0], *v) for r, secret in zip(rows[:cut], y[:cut]) if not secret for v in looks(*r)[1:]])
    network.train(np.concatenate([x[:cut], more]), np.concatenate([y[:cut], np.zeros(len(more))]))
    network.calibrate(x[cut:], y[cut:], recall)
    return network


def scan(texts: list[str], network: Network) -> list[tuple[list[Span], list[Span], int]]:
    """Of each text the base findings, all findings, and how many base findings the network finds as well."""
    base = [base_spans(t) for t in texts]
    found = [(i, s, e, None) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
    found += [(i, s, e, kind) for i, spans in enumerate(base) for kind, s, e in spans]
    every, likely = [list(b) for b in base], [0] * len(texts)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        seen = [looks(texts[i], s, e) for i, s, e, _ in part]
        first = np.cumsum([0, *map(len, seen)])[:-1]
        # Windows of very long runs are many: no more than some thousand are held at a time.
        views = ((texts[i], s, e) for (i, *_), x in zip(part, seen) for s, e in x)
        p = np.concatenate([network.probability(np.array([window(*v) for v in some])) for some in batched(views, 4096)])
        for (i, s, e, kind), yes in zip(part, np.maximum.reduceat(p, first) >= max(network.threshold, 1e-9)):
            if yes and kind is None:
                every[i].append(("network", s, e))
            likely[i] += bool(yes and kind)
    return [(b, sorted(x, key=lambda s: (s[1], KINDS.index(s[0]))), n) for b, x, n in zip(base, every, likely)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long, n_base_likely long"


def _scan(batches: Iterator[pa.RecordBatch], network) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_network", pa.int64()), ("n_base_likely", pa.int64())])
    for batch in small_slices(batches):
        found = scan(batch.column("text").to_pylist(), network.value)
        counts = {f"n_{k}": [sum(s[0] == k for s in every) for _, every, _ in found] for k in KINDS}
        digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _, _ in found]
        yield batch_of({"doc_id": batch.column("doc_id"), "base_sha256": digests, "spans": [joined(x) for _, x, _ in found], "n_base_likely": [n for _, _, n in found], **counts}, schema)


def find_secrets(docs: DataFrame, network: Network) -> DataFrame:
    """One row per document: counts by kind, the base findings' digest, all spans, how many the network added, how many base findings it finds as well."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return texts_of(docs).mapInArrow(functools.partial(_scan, network=shared), _FOUND)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """Text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_column(network):
    """A column function: a text column without its secrets, for a broadcast network; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for b in small_slices(iter([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])])):
                rows = b.column("text").to_pylist()
                out += [t if t is None else redact(t, every) for t, (_, every, _) in zip(rows, scan([t or "" for t in rows], network.value))]
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), trained())
