"""Toxicity by Levenshtein automata intersected with a lexicon trie, and scores of context windows.

The lexicon is learned from labelled texts: words, and word beginnings, that toxic texts have far more
often.  They form a trie; its product with the Levenshtein automaton of distance one (for longer words) is
made deterministic once and run over every word of every whole text at the same time, character by
character, in numpy; most words leave it after three or four characters.  Tokens with digits or marks between
their letters pass it too, with these as symbols: one that commonly stands for a letter is read as that
letter, another as a character of no term, which the automaton forgives as it does a wrong letter.  Each hit
is seen with the window around it: hits between quotation marks count apart from plain ones, and hits with
another hit nearby count as bursts.  A logistic regression on these counts, on how many words come near the
lexicon and on the text's length gives the score, so texts without hits differ too.

Learning uses a bounded, documented sample (about ``per_class`` labelled texts of either class, chosen by
hashes; ``lexicon_size`` candidates for the lexicon); lexicon, automaton and regression are broadcast.  A term
needs a surprise that shrinks with the number of toxic texts, so few labels give a lexicon as well.  A word
within one edit of a term is harmless if plain (unquoted) occurrences in the sample speak for clean texts.

Defined cases: null text counts as empty; a text without hits has the regression's base score; documents
with several labels count as toxic if one says so; null labels are not learned from; without labelled texts
all score 0; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, id_remainder, small_slices, stored, table, texts_of
from .langid import letters

PER_CLASS = 4_000
#: Candidates for the lexicon.
LEXICON = 1_000
LEAST_LIFT, LEAST_SURPRISE = 10, 12
#: Where few texts are toxic, this share of the surprise of a term that all of them have is enough.
SHARE_OF_SURPRISE = 0.2
#: Share of toxic texts from which a term needs no other reason.
COMMON = 0.03
#: Characters on either side of a hit.
WINDOW = 60
FUZZY_FROM = 5
STEM_LENGTHS = (4, 5, 6, 7)
#: Characters that open or close a quotation.
QUOTES = "\"“”„«»‹›"
#: Digits and marks that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
N_FEATURES = 9
#: Characters after which a word that is still in the automaton counts as near the lexicon.
NEAR_AFTER = 3

_WORD = regex.compile(r"\p{L}+")
EXACT, STEM, FUZZY = 1, 2, 3


class Automaton:
    """Deterministic product of the lexicon's trie and the Levenshtein automaton of distance 1.

    table[state, symbol] is the next state, 0 is dead; accept[state] tells what a word ending there is
    (EXACT, FUZZY, or 0) and weight[state] its lexicon weight.  STEM states accept at once.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], harmless: tuple[str, ...] = ()):
        self.alphabet = {c: k for k, c in enumerate(sorted(set("".join([*words, *stems, *harmless]))), 1)}  # 0: any other
        nodes: list[dict[str, int]] = [{}]
        is_word: dict[int, float] = {}
        is_stem: dict[int, float] = {}
        is_harmless: dict[int, float] = {}
        fuzzy_ok: set[int] = set()  # nodes on the way to a word that may be misspelt
        for terms, ends in ((words, is_word), (stems, is_stem), (dict.fromkeys(harmless, 0.0), is_harmless)):
            for term, w in terms.items():
                at = 0
                if terms is words and len(term) >= FUZZY_FROM:
                    fuzzy_ok.add(0)
                for c in term:
                    if c not in nodes[at]:
                        nodes[at][c] = len(nodes)
                        nodes.append({})
                    at = nodes[at][c]
                    if terms is words and len(term) >= FUZZY_FROM:
                        fuzzy_ok.add(at)
                ends[at] = w
        long_word = {n: w for n, w in is_word.items() if n in fuzzy_ok}

        def closed(pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With what a character left out of the text allows."""
            out = set(pairs)
            for n, e in pairs:
                if e == 0:
                    out |= {(m, 1) for m in nodes[n].values() if m in fuzzy_ok and n in fuzzy_ok}
            return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

        start = closed({(0, 0)})
        states, queue, rows = {frozenset(): 0, start: 1}, [start], [None]
        symbols = [None, *self.alphabet]
        kinds, weights, table = [0], [0.0], [[0] * len(symbols)]
        while queue:
            current = queue.pop(0)
            stem = max((is_stem[n] for n, e in current if e == 0 and n in is_stem), default=None)
            exact = max((is_word[n] for n, e in current if e == 0 and n in is_word), default=None)
            fuzzy = max((long_word[n] for n, e in current if e == 1 and n in long_word), default=None)
            if exact is None and any(e == 0 and n in is_harmless for n, e in current):
                fuzzy = None
            kinds.append(EXACT if exact is not None else STEM if stem is not None else FUZZY if fuzzy is not None else 0)
            weights.append(next((x for x in (exact, stem, fuzzy) if x is not None), 0.0))
            row = []
            for c in symbols:
                after: set[tuple[int, int]] = set()
                for n, e in current:
                    if c in nodes[n]:
                        after.add((nodes[n][c], e))
                    if e == 0 and n in fuzzy_ok:
                        after.add((n, 1))  # a character too many
                        after |= {(m, 1) for m in nodes[n].values() if m in fuzzy_ok}  # another character
                follow = closed({(n, e) for n, e in after if e == 0 or n in fuzzy_ok})
                if follow not in states:
                    states[follow] = len(states)
                    queue.append(follow)
                row.append(states[follow])
            table.append(row)
        self.table = np.array(table, np.int32)
        self.kind, self.weight = np.array(kinds, np.int8), np.array(weights, np.float32)
        self.symbol = np.zeros(0x110000, np.int32)
        for c, k in self.alphabet.items():
            self.symbol[ord(c)] = k
        # A stem is found when its last letter is read, whatever follows; no listed word goes on from it.
        self.stops = self.kind == STEM

    def hits(self, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, kinds and weights of the words of `lower` (letters, 0 elsewhere, 0 at both ends) that the automaton accepts."""
        return self.walk(lower)[:3]

    def walk(self, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The hits, and the starts of the words that are in the automaton for NEAR_AFTER characters."""
        is_letter = lower != 0
        starts = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
        symbol = self.symbol[lower]
        state = np.ones(len(starts), np.int32)
        word, at = np.arange(len(starts)), starts.copy()
        found, kind, weight, depth, near = [], [], [], 0, starts[:0]
        while len(word):
            ended = ~is_letter[at]
            state = np.where(ended, state, self.table[state, symbol[at]])
            over = ended & (self.kind[state] > 0) | self.stops[state]
            if over.any():
                found.append(starts[word[over]])
                kind.append(self.kind[state[over]])
                weight.append(self.weight[state[over]])
            on = ~ended & ~over & (state != 0)
            word, at, state = word[on], at[on] + 1, state[on]
            depth += 1
            if depth == NEAR_AFTER:
                near = starts[word]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.float32), near
        found, kind, weight = map(np.concatenate, (found, kind, weight))
        order = np.argsort(found, kind="stable")
        return found[order], kind[order], weight[order], near


@functools.lru_cache(maxsize=1)
def _marks() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 1 a mark or digit that may stand within a word, 2 one that stands for a letter, 0 another; and the character it is read as (1: one of no term)."""
    kind, read = np.zeros(0x110000, np.uint8), np.ones(0x110000, np.uint32)
    for c in range(0x21, 0x3000):
        if not (chr(c).isalpha() or chr(c).isspace() or chr(c) in QUOTES):
            kind[c] = 1
    for c, letter in STANDS_FOR.items():
        kind[ord(c)], read[ord(c)] = 2, ord(letter)
    return kind, read


def masked(code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with digits or marks between their letters: their characters as the automaton reads them, 0 between tokens; where each begins there and in the text.

    A token is a run without white space or quotation marks, without the marks at its ends; those that stand for letters stay, but for a last exclamation mark.
    """
    kind, read = _marks()
    mark = np.where(lower == 0, kind[code], 0)
    inside = (lower != 0) | (mark > 0)
    place = np.arange(len(code))
    keep_first = (lower != 0) | (mark == 2)
    keep_last = keep_first & (code != ord("!"))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:])
    first = np.minimum.accumulate(np.where(keep_first, place, len(code))[::-1])[::-1][starts]
    last = np.maximum.accumulate(np.where(keep_last, place, -1))[ends]
    marks, letters_ = np.cumsum(mark > 0), np.cumsum(lower != 0)
    ok = (first < last) & (last <= ends)
    first, last = first[ok], last[ok]
    ok = (marks[last] > marks[first] - (mark[first] > 0)) & (letters_[last] - letters_[first] + (lower[first] != 0) >= 2)
    first, last = first[ok], last[ok]
    size = last - first + 2  # with the 0 before the next token
    begin = np.cumsum(size) - size + 1
    out = np.zeros(int(size.sum()) + 2, np.uint32)
    shift = np.repeat(begin - first, size - 1)
    at = np.arange(len(shift)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1) + np.repeat(first, size - 1)
    out[at + shift] = np.where(lower[at] != 0, lower[at], read[code[at]])
    return out, begin, first


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float], harmless: tuple[str, ...] = ()):
        """harmless: words that resemble a lexicon word but occur in clean texts."""
        self.words, self.stems, self.harmless = words, stems, harmless
        self.automaton = Automaton(words, stems, harmless)

    def resembling(self, text: str) -> set[str]:
        """The words of the text, outside quotations, that count as misspelt lexicon words."""
        lower, _ = letters([text])
        at, kind, _ = self.automaton.hits(lower)
        return {_WORD.match(text, int(i) - 1)[0].lower() for i in at[kind == FUZZY] if not self._quoted(text, int(i) - 1)}

    def _hits(self, texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, kinds and weights of words, and of masked tokens in which no word was found; the starts of words near the lexicon."""
        at, kind, weight, near = self.automaton.walk(lower)
        code = np.frombuffer(("\0" + "\0\0".join(texts) + "\0\0\0").encode("utf-32-le", "replace"), np.uint32)
        read, begin, first = masked(code, lower)
        if len(begin):
            at2, _, weight2 = self.automaton.hits(read)
            token = np.searchsorted(begin, at2, side="right") - 1
            whole = begin[token] == at2  # a stem or word at the token's begin
            at2, weight2, token = first[token[whole]], weight2[whole], token[whole]
            after = np.r_[begin[1:], len(read)] - begin - 1  # the token's length
            apart = np.searchsorted(at, at2) == np.searchsorted(at, at2 + after[token])
            at, kind, weight = np.r_[at, at2[apart]], np.r_[kind, np.full(apart.sum(), FUZZY, np.int8)], np.r_[weight, weight2[apart]]
            order = np.argsort(at, kind="stable")
            at, kind, weight = at[order], kind[order], weight[order]
        return at, kind, weight, near

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: weights of plain exact, stem and misspelt hits, of quoted ones, bursts, any hit, the share of words hit, the share near the lexicon, and the number of words (log)."""
        out = np.zeros((len(texts), N_FEATURES))
        if not texts:
            return out
        lower, starts = letters(texts)
        at, kind, weight, close = self._hits(texts, lower)
        n_words = np.add.reduceat(np.r_[False, (lower[1:] != 0) & (lower[:-1] == 0)].astype(np.int64), starts)
        out[:, 7] = np.bincount(np.searchsorted(starts, close, side="right") - 1, minlength=len(texts)) / np.maximum(1, n_words)
        out[:, 8] = np.log1p(n_words) / 10
        if not len(at):
            return out
        doc = np.searchsorted(starts, at, side="right") - 1
        near = np.zeros(len(at), bool)
        near[1:] |= (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] <= WINDOW)
        near[:-1] |= near[1:]
        quoted = np.zeros(len(at), bool)
        for i, (d, p) in enumerate(zip(doc.tolist(), at.tolist())):
            place = p - int(starts[d]) - 1
            quoted[i] = self._quoted(texts[d], place)
        for k in (EXACT, STEM, FUZZY):
            plain = (kind == k) & ~quoted
            out[:, k - 1] = np.log1p(np.bincount(doc[plain], weight[plain], len(texts)))
        out[:, 3] = np.log1p(np.bincount(doc[quoted], weight[quoted], len(texts)))
        out[:, 4] = np.log1p(np.bincount(doc[near & ~quoted], minlength=len(texts)))
        out[:, 5] = np.bincount(doc[~quoted & (kind > 0)], minlength=len(texts)) > 0
        out[:, 6] = np.minimum(1, 20 * np.bincount(doc[~quoted], minlength=len(texts)) / np.maximum(1, n_words))
        return out

    @staticmethod
    def _quoted(text: str, place: int) -> bool:
        """Whether the window has a quotation mark on either side of the place, in the same line."""
        before = text[max(0, place - WINDOW) : place].rpartition("\n")[2]
        after = text[place : place + WINDOW].partition("\n")[0]
        return any(c in QUOTES for c in before) and any(c in QUOTES for c in after)


class Model:
    def __init__(self, lexicon: Lexicon | None, w: np.ndarray, b: float):
        self.lexicon, self.w, self.b = lexicon, w, b

    def score(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.lexicon.features(texts) @ self.w + self.b, -30, 30)))


def _terms(text: str) -> tuple[set[str], set[str]]:
    words = set(_WORD.findall(text.lower()))
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts: list[Counter] = [Counter() for _ in range(4)]

    def rows() -> Iterator[pa.RecordBatch]:
        for stem in (0, 1):
            toxic, clean = counts[2 * stem], counts[2 * stem + 1]
            # Terms of clean texts alone cannot enter the lexicon.
            keys = [*toxic]
            yield batch_of({"term": keys, "stem": [bool(stem)] * len(keys), "toxic": [toxic[k] for k in keys], "clean": [0] * len(keys)}, schema)
            keys = [*clean]
            yield batch_of({"term": keys, "stem": [bool(stem)] * len(keys), "toxic": [0] * len(keys), "clean": [clean[k] for k in keys]}, schema)
        for c in counts:
            c.clear()

    for batch in small_slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words, stems = _terms(text)
            counts[0 if toxic else 1].update(words)
            counts[2 if toxic else 3].update(stems)
        if sum(map(len, counts)) > 300_000:
            yield from rows()
    yield from rows()


def _held_terms(batches: Iterator[pa.RecordBatch], terms: list[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    """Of each text its label and which of the terms it has."""
    schema = pa.schema([("toxic", pa.int32()), ("held", pa.list_(pa.int32()))])
    place = {t: k for k, t in enumerate(terms)}
    for batch in small_slices(batches):
        held = []
        for text in batch.column("text").to_pylist():
            words, stems = _terms(text)
            held.append([place[t] for x, stem in ((words, False), (stems, True)) for t in ((w, stem) for w in x) if t in place])
        yield batch_of({"toxic": batch.column("toxic"), "held": held}, schema)


def _resembling(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32())])
    for batch in small_slices(batches):
        found = [(w, y) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) for w in lexicon.resembling(t)]
        yield batch_of({"word": [w for w, _ in found], "toxic": [y for _, y in found]}, schema)


def surprise_of(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of the term's toxic texts against chance."""
    return toxic * math.log((toxic + 0.5) / (toxic + clean + 1) / (n_toxic / (n_toxic + n_clean)))


def least_surprise(n_toxic: int, n_clean: int) -> float:
    return min(LEAST_SURPRISE, SHARE_OF_SURPRISE * surprise_of(n_toxic, 0, n_toxic, max(1, n_clean)))


def choose(terms: list[tuple[str, bool]], rows: list) -> Lexicon:
    """Terms one by one: always the most surprising one among the toxic texts that no chosen term explains.

    What texts share only because they are copies of one another goes with the term that made them toxic.
    Between terms that explain about as much a word beats a beginning, and the longer the shorter.
    """
    toxic = np.array([bool(r["toxic"]) for r in rows])
    has = np.zeros((len(rows), len(terms)), bool)
    for i, r in enumerate(rows):
        has[i, r["held"]] = True
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    clean = has[~toxic].sum(axis=0)
    every = has[toxic].sum(axis=0)
    open_rows = has[toxic]
    weight = np.log((every + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    words, stems = {}, {}

    def add(k: int) -> None:
        (stems if terms[k][1] else words)[terms[k][0]] = float(weight[k])

    def first(gain: list[float]) -> int:
        near = [k for k in range(len(terms)) if gain[k] >= 0.95 * max(gain)]
        return max(near, key=lambda k: (not terms[k][1], len(terms[k][0]), gain[k], terms[k][0]))

    least = least_surprise(n_toxic, n_clean)
    while len(open_rows):
        found = open_rows.sum(axis=0).tolist()
        gain = [surprise_of(t, c, len(open_rows), n_clean) if t else 0.0 for t, c in zip(found, clean.tolist())]
        best = first(gain)
        if gain[best] < least:
            break
        add(best)
        open_rows = open_rows[~open_rows[:, best]]
    # Terms that many toxic texts have and next to no others, though each of these has another term too.
    for k in sorted(range(len(terms)), key=lambda k: (-every[k], terms[k][1], -len(terms[k][0]), terms[k][0])):
        term, is_stem = terms[k]
        if every[k] < COMMON * n_toxic or weight[k] < math.log(10 * LEAST_LIFT) or any(term.startswith(t) for t in stems):
            continue
        if is_stem and any(t.startswith(term) for t in [*words, *stems]):
            continue
        add(k)
    return Lexicon({w: x for w, x in words.items() if not any(w.startswith(t) for t in stems)}, stems)


def _feature_rows(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])
    for batch in small_slices(batches, 2_000_000):
        x = lexicon.value.features(batch.column("text").to_pylist())
        yield batch_of({"toxic": batch.column("toxic"), "x": x.tolist()}, schema)


#: Weights before learning: a misspelt term counts as a term until labelled texts tell otherwise.
PRIOR = (2.0, 2.0, 2.0, 0.0, 0.0, 1.0, 0.5, 0.1, 0.1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias, by Newton steps from and towards PRIOR; the classes weigh as they occur."""
    rows = np.c_[x, np.ones(len(x))]
    prior = np.array([*PRIOR, -4.0])
    w = prior.copy()
    hold = np.full(rows.shape[1], penalty)
    hold[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows / len(x) + np.diag(hold) / 10 + 1e-9 * np.eye(len(w)), rows.T @ (y - p) / len(x) - hold * (w - prior) / 10)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, allowed, per_class: int = PER_CLASS, lexicon_size: int = LEXICON) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, toxic), for labels where the condition `allowed` holds."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(1):
        return Model(None, np.zeros(N_FEATURES), 0.0)
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), 1_000_000) / 1_000_000.0
    sampled = known.where(share < F.when(F.col("toxic") == 1, F.lit(per_class / n[1])).otherwise(F.lit(per_class / max(1, n.get(0, 0)))))
    # About 2 * per_class ids: a proven bound.
    texts = stored(texts_of(docs).join(F.broadcast(sampled), "doc_id").select("doc_id", "text", "toxic").dropDuplicates())
    # An id may have many texts: of more rows than the sample is meant to hold, a share by hash stays.
    n_texts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    kept = F.pmod(F.xxhash64("doc_id", "text"), 1_000_000) / 1_000_000.0 < F.when(F.col("toxic") == 1, min(1.0, 2 * per_class / max(1, n_texts.get(1, 0)))).otherwise(min(1.0, 2 * per_class / max(1, n_texts.get(0, 0))))
    texts = texts.where(kept).drop("doc_id")
    counts = texts.mapInArrow(_count_terms, "term string, stem boolean, toxic long, clean long")
    n_toxic, n_clean = min(n[1], per_class), min(n.get(0, 0), per_class)
    lift = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    surprise = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) / (n_toxic / (n_toxic + n_clean)))
    best = (
        counts.groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((surprise >= least_surprise(n_toxic, n_clean)) & (lift >= min(LEAST_LIFT, n_toxic / 4)))
        .orderBy(F.desc(surprise), "term", "stem")
        .limit(lexicon_size)
        .collect()
    )
    terms = [(r["term"], r["stem"]) for r in best]
    if not terms:
        return Model(None, np.zeros(N_FEATURES), 0.0)
    lexicon = choose(terms, texts.mapInArrow(functools.partial(_held_terms, terms=terms), "toxic int, held array<int>").collect())
    seen = texts.mapInArrow(functools.partial(_resembling, lexicon=lexicon), "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    # Words of the bounded sample one edit from a term.
    harmless = seen.where((F.col("n") - F.col("toxic") + 0.5) / (n_clean + 1) > (F.col("toxic") + 0.5) / (n_toxic + 1)).orderBy("word").collect()
    lexicon = Lexicon(lexicon.words, lexicon.stems, tuple(r["word"] for r in harmless))
    shared = spark.sparkContext.broadcast(lexicon)
    rows = texts.mapInArrow(functools.partial(_feature_rows, lexicon=shared), "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in rows], float)
    return Model(lexicon, *logistic(x, y))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    for batch in small_slices(batches, 2_000_000):
        s = model.value.score(batch.column("text").to_pylist())
        yield batch_of({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}, schema)


def score_column(model):
    """A column function: the score of a text column, for a broadcast model."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = small_slices(iter([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])]), 2_000_000)
            rows = [model.value.score([t or "" for t in b.column("text").to_pylist()]) for b in parts]
            yield pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts_of(docs).select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(functools.partial(_score, model=shared), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_remainder("doc_id", 5) == 0
    return score(docs, learn(docs, labels, ~held), held)
