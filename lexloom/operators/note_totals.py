"""Counters of annotated notes in the two-stage mode, sentence by sentence: what `annotate.annotated_numbers` makes a row for each node of.

A word's counters are kept by word.  A phrase's selection is kept by the classes of its words; only the wording is chosen
by its text.  Words that could make a note invalid are marked, so that only notes that quote one are judged as a whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa

from ..plans import views as V
from . import annotate as A
from . import notes
from .dataset import CONCESSION_OPENERS, REASON_OPENERS, TIME_OPENERS
from .emission_totals import _BEFORE, _CLASSES, _HAD, _HAVE, _MODAL, Classes

#: What is counted, in fields of so many bits of one number.
FIELDS, BITS = ("nodes", "model_notes", "rejected_nodes", "l1_exact", "l2_drop_tam", "l3_level_pos", "l4_fallback", "tam_drop_nodes"), 40
_UNIT = {f: 1 << BITS * k for k, f in enumerate(FIELDS)}
_LEVELS = FIELDS[3:7]
#: Words and shapes that are kept.
KEPT = 200_000
#: Added to the class of a word that could make a note invalid: a noise word, or one that holds the letters by which a bad pattern begins.
MARK = 64
_BEGINS = re.compile("|".join(sorted({re.match(r"(?:\\b)?([a-z]*)", p)[1] for p in notes.BAD_INSIDE})))
_PLAIN = re.compile("[a-z]{4,}")


def marked(w: str) -> bool:
    return w in notes.NOISE_WORDS or _BEGINS.search(w) is not None


class Marked(Classes):
    """Words' classes, with their mark."""

    def __missing__(self, w: str) -> int:
        found = self[w] = super().__missing__(w) | (MARK if marked(w) else 0)
        return found


def compatible(template: str, kind: str, pos: str, lex: str, tam2: str, first: str, vbn: bool) -> bool:
    """notes.compatible of one node."""
    if kind == "Sentence":
        openers = {"CLAUSE_SUBORDINATE_CONCESSION": ("although", "though", "even"), "CLAUSE_SUBORDINATE_REASON": REASON_OPENERS, "CLAUSE_SUBORDINATE_TIME": TIME_OPENERS}
        return first in openers[template] if template in openers else template == "SENTENCE_FINITE_CLAUSE"
    if kind == "Phrase":
        rules = {
            "PP_TIME_BEFORE_ING": pos == "prepositional phrase" and lex == "before_ing", "PP_GENERAL_LINKING": pos == "prepositional phrase", "NP_POSSESSIVE": pos == "noun phrase" and lex == "possessive", "NP_DETERMINER_NOUN": pos == "noun phrase",
            "VP_MODAL_PERFECT": pos == "verb phrase" and tam2 == "modal_perfect", "VP_AUXILIARY": pos == "verb phrase", "VP_PARTICIPLE": pos == "verb phrase",
        }
    else:
        rules = {
            "WORD_AUX_MODAL": pos == "auxiliary verb" and first in V.MODALS, "WORD_AUX_HAVE": pos == "auxiliary verb" and first == "have", "WORD_AUX_GENERAL": pos == "auxiliary verb", "WORD_VERB_ING": pos == "verb" and first.endswith("ing"), "WORD_VERB_PARTICIPLE": pos == "verb" and vbn,
            "WORD_VERB_FINITE": pos == "verb" and not vbn, "WORD_PRONOUN_POSSESSIVE": pos == "pronoun", "WORD_NOUN_COMMON": pos in ("noun", "proper noun"), "WORD_ARTICLE_DEFINITE": pos in ("article", "determiner") and first == "the", "WORD_PREPOSITION": pos == "preposition",
            "WORD_ADJECTIVE": pos == "adjective", "WORD_ADVERB": pos == "adverb",
        }
    return rules.get(template, True)


def suits(kind: str, pos: str, content: str, tense: str | None, note: str) -> bool:
    """Whether a note is valid and suits its node: annotate.SUITABLE."""
    low = note.lower()
    if not notes.is_valid(note) or (kind != "Sentence" and "subordinate clause" in low):
        return False
    if pos == "prepositional phrase" and content.startswith(("before ", "after ")) and ("concession" in low or "reason" in low):
        return False
    if kind == "Word":
        return f"'{content}'" in low
    if kind == "Phrase":
        longer = _PLAIN.findall(content)[:2]
        return "phrase" in low and (not longer or any(x in low for x in longer))
    return "sentence" in low and not (tense == "past" and "present simple" in low) and not (tense == "present" and "past simple" in low)


class Selection:
    """The template of nodes of a type and of words of some classes; first: the first word, which words and sentences are asked for."""

    def __init__(self, kind: str, classes: bytes, first: str):
        plain = [c & ~MARK for c in classes]
        pos, tags = [_CLASSES[c][0] for c in plain], [_CLASSES[c][1] for c in plain]
        perfect = _MODAL in plain and _HAVE in plain
        self.kind, self.marked = kind, any(c & MARK for c in classes)
        self.tense = "past" if not perfect and _HAD in plain else None
        tam2 = "modal_perfect" if perfect and kind != "Word" else "none"
        if kind == "Sentence":
            self.pos, dep = "sentence", "clause"
            lex = next((x for openers, x in ((TIME_OPENERS, "time_subordinator"), (REASON_OPENERS, "reason_subordinator"), (CONCESSION_OPENERS, "concession_subordinator")) if first in openers), "generic")
        elif kind == "Phrase":
            self.pos = "prepositional phrase" if "ADP" in pos else "verb phrase" if "AUX" in pos or "VERB" in pos else "noun phrase"
            dep = {"prepositional phrase": "prep", "verb phrase": "predicate"}.get(self.pos, "object")
            # Possessives are the only pronouns; any word in -ing is tagged VBG.
            lex = "possessive" if self.pos == "noun phrase" and "PRON" in pos else "before_ing" if plain[0] == _BEFORE and "VBG" in tags[1:] else "generic"
        else:
            self.pos, dep = notes.WORD_CLASS.get(pos[0], ""), notes.WORD_DEP.get(pos[0], "dep")
            lex = (
                "modal_aux" if self.pos == "auxiliary verb" and first in V.MODALS else "have_aux" if self.pos == "auxiliary verb" and first == "have" else "def_article" if self.pos == "article" and first == "the" else "possessive" if self.pos == "pronoun"
                else "ing_form" if self.pos == "verb" and first.endswith("ing") else "participle_form" if self.pos == "verb" and tags[0] == "VBN" else "generic"
            )
        level = kind.lower()
        keys = (f"{level}|{self.pos}|{dep}|{tam2}|{lex}", f"{level}|{self.pos}|{dep}|{lex}", f"{level}|{self.pos}", level)
        tries = [(k, r[key], key) for k, (r, key) in enumerate(zip((notes.REGISTRY_L1, notes.REGISTRY_L2, notes.REGISTRY_L3, notes.REGISTRY_L4), keys)) if key in r]
        good = [x for x in tries if compatible(x[1], kind, self.pos, lex, tam2, first, tags[0] == "VBN")]
        k, template, key = good[0] if good else (3, None, level)
        self.exact = k < 2
        self.counts = _UNIT["nodes"] + _UNIT[_LEVELS[k]] + (len(tries) > len(good)) * _UNIT["rejected_nodes"] + (k == 1 and self.pos in A.TAM_CLASSES) * _UNIT["tam_drop_nodes"]
        self.before, self.after = f"{template}|".encode(), f"|{key}".encode()
        found = () if template is None else A.MODAL_PERFECT_VARIANTS if template == "SENTENCE_FINITE_CLAUSE" and tam2 == "modal_perfect" else A.TEMPLATE_VARIANTS[template]
        self.wordings = [self._wording(w) for w in found]
        # Only prepositional phrases are asked whether they begin with a word of time.
        self.quick = kind != "Sentence" and not self.marked

    def _wording(self, w: str) -> tuple[str, str, str, bool, bool | None]:
        """A wording, its lower-cased parts around the text, whether it quotes the text, and its verdict: for a sentence's that quotes nothing, or if no word is marked; None: by the text.

        No pattern matches a quote, so that one is found in the wording or in the text; and a note that quotes a word or phrase holds its longer words.
        """
        left, quotes, right = w.lower().partition("{content}")
        if self.kind == "Sentence":
            verdict = None if quotes else suits(self.kind, self.pos, "", self.tense, w)
        elif quotes:
            verdict = suits(self.kind, "", "x", self.tense, w.replace("{content}", "x")) and w.count("{") == 1 and "'{content}'" in w or None
        else:
            verdict = None if self.kind == "Phrase" and suits(self.kind, "", "", self.tense, w) else False
        return w, left, right, bool(quotes), verdict

    def note(self, content: str) -> str | None:
        """The lower-cased note of such a node if it is tried, else None."""
        if not self.wordings:
            return None
        digest = hashlib.sha256(self.before + content.encode() + self.after).digest()
        wording, left, right, quotes, verdict = self.wordings[int.from_bytes(digest[:4], "big") % len(self.wordings)]
        if not self.exact:
            return left + content + right if quotes else left
        if self.kind == "Sentence":
            if verdict is not None:
                return left if verdict else None
        elif self.quick and (self.pos != "prepositional phrase" or not content.startswith(("before ", "after "))):
            if verdict:
                return left + content + right
            if verdict is False:
                return None
            if not quotes:
                longer = _PLAIN.findall(content)[:2]
                return left if not longer or any([x in left for x in longer]) else None
        low = left + content + right if quotes else left
        return low if suits(self.kind, self.pos, content, self.tense, wording.replace("{content}", content)) else None


class WordCounts(dict):
    """Counters of words."""

    def __init__(self, classes: Marked):
        super().__init__()
        self.classes = classes
        self.selections: dict[int, Selection] = {}

    def __missing__(self, w: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        c = self.classes[w]
        s = self.selections.get(c)
        if s is None:
            # Words that rules ask for have a class of their own.
            s = self.selections[c] = Selection("Word", bytes((c,)), w)
        found = self[w] = s.counts + (s.note(w) is not None) * _UNIT["model_notes"]
        return found


class Counter:
    def __init__(self):
        self.classes = Marked()
        self.words = WordCounts(self.classes)
        self.phrases: dict[bytes, Selection] = {}
        self.sentences: dict[tuple[bytes, str], Selection] = {}

    def sentence(self, text: str) -> int:
        """Counters of a sentence of words with a space between them, and of its nodes."""
        toks = text.split(" ")
        size, known, phrases, words = V.PHRASE_TOKENS, self.classes, self.phrases, self.words
        classes = bytes(map(known.__getitem__, toks))
        asked = bytes(sorted(_ASKED.intersection(classes.translate(_UNMARKED)))) or bytes(1)
        key = asked, toks[0] if toks[0] in _OPENERS else ""
        top = self.sentences.get(key)
        if top is None:
            top = self.sentences[key] = Selection("Sentence", *key)
        total, said = top.counts + sum(map(words.__getitem__, toks)), {top.note(text)}
        for a in range(0, len(toks), size):
            part = classes[a : a + size]
            s = phrases.get(part)
            if s is None:
                if len(phrases) >= KEPT:
                    phrases.clear()
                s = phrases[part] = Selection("Phrase", part, "")
            total += s.counts
            said.add(s.note(" ".join(toks[a : a + size])))
        # A note counts where it is new in its sentence.
        return total + (len(said) - (None in said)) * _UNIT["model_notes"]


_OPENERS = {*TIME_OPENERS, *REASON_OPENERS, *CONCESSION_OPENERS, "even"}
#: Classes that a sentence is asked for; classes without their mark.
_ASKED, _UNMARKED = {_MODAL, _HAVE, _HAD}, bytes(k & ~MARK for k in range(256))
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in FIELDS]])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, words) the counters of each document's sentences in a batch."""
    counter, low = Counter(), (1 << BITS) - 1
    # What is kept by word holds no cycles, and the collector would walk it again and again.
    gc.disable()
    try:
        for batch in batches:
            found: dict[int, int] = {}
            for doc, words in zip(batch["doc_id"].to_pylist(), batch["words"].to_pylist()):
                found[doc] = found.get(doc, 0) + counter.sentence(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *[pa.array([x >> BITS * k & low for x in found.values()], pa.int64()) for k in range(len(FIELDS))]], schema=SCHEMA)
    finally:
        gc.enable()
