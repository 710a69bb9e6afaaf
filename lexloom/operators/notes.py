"""Notes: template cascade with back-off, compatibility, fallback notes, validity, novelty, rejected candidates, hard negatives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import views as V
from .dataset import CONCESSION_OPENERS, REASON_OPENERS, TIME_OPENERS

#: Template registries, from the fullest context key to the barest.
REGISTRY_L1 = {
    "sentence|sentence|clause|none|time_subordinator": "CLAUSE_SUBORDINATE_TIME",
    "sentence|sentence|clause|none|reason_subordinator": "CLAUSE_SUBORDINATE_REASON",
    "sentence|sentence|clause|none|concession_subordinator": "CLAUSE_SUBORDINATE_CONCESSION",
    "phrase|verb phrase|predicate|modal_perfect|generic": "VP_MODAL_PERFECT",
    "phrase|verb phrase|predicate|none|generic": "VP_AUXILIARY",
    "phrase|verb phrase|dep|modal_perfect|generic": "VP_MODAL_PERFECT",
    "phrase|verb phrase|dep|none|generic": "VP_AUXILIARY",
    "phrase|noun phrase|object|none|possessive": "NP_POSSESSIVE",
    "phrase|noun phrase|object|none|generic": "NP_DETERMINER_NOUN",
    "phrase|noun phrase|dep|none|possessive": "NP_POSSESSIVE",
    "phrase|noun phrase|dep|none|generic": "NP_DETERMINER_NOUN",
    "phrase|prepositional phrase|modifier|none|before_ing": "PP_TIME_BEFORE_ING",
    "phrase|prepositional phrase|prep|none|before_ing": "PP_TIME_BEFORE_ING",
    "phrase|prepositional phrase|modifier|none|generic": "PP_GENERAL_LINKING",
    "phrase|prepositional phrase|prep|none|generic": "PP_GENERAL_LINKING",
    "word|auxiliary verb|aux|none|modal_aux": "WORD_AUX_MODAL",
    "word|auxiliary verb|aux|none|have_aux": "WORD_AUX_HAVE",
    "word|auxiliary verb|aux|none|generic": "WORD_AUX_GENERAL",
    "word|verb|root|none|ing_form": "WORD_VERB_ING",
    "word|verb|root|none|participle_form": "WORD_VERB_PARTICIPLE",
    "word|verb|root|none|generic": "WORD_VERB_FINITE",
    "word|verb|dep|none|ing_form": "WORD_VERB_ING",
    "word|verb|dep|none|participle_form": "WORD_VERB_PARTICIPLE",
    "word|verb|dep|none|generic": "WORD_VERB_FINITE",
    "word|pronoun|poss|none|possessive": "WORD_PRONOUN_POSSESSIVE",
    "word|preposition|prep|none|generic": "WORD_PREPOSITION",
    "word|adjective|dep|none|generic": "WORD_ADJECTIVE",
    "word|adjective|amod|none|generic": "WORD_ADJECTIVE",
    "word|adverb|dep|none|generic": "WORD_ADVERB",
    "word|adverb|advmod|none|generic": "WORD_ADVERB",
}
REGISTRY_L2 = {
    "sentence|sentence|clause|time_subordinator": "CLAUSE_SUBORDINATE_TIME",
    "sentence|sentence|clause|reason_subordinator": "CLAUSE_SUBORDINATE_REASON",
    "sentence|sentence|clause|concession_subordinator": "CLAUSE_SUBORDINATE_CONCESSION",
    "sentence|sentence|clause|generic": "SENTENCE_FINITE_CLAUSE",
    "phrase|verb phrase|predicate|generic": "VP_AUXILIARY",
    "phrase|verb phrase|dep|generic": "VP_AUXILIARY",
    "phrase|noun phrase|object|possessive": "NP_POSSESSIVE",
    "phrase|noun phrase|dep|possessive": "NP_POSSESSIVE",
    "phrase|noun phrase|object|generic": "NP_DETERMINER_NOUN",
    "phrase|noun phrase|dep|generic": "NP_DETERMINER_NOUN",
    "phrase|prepositional phrase|modifier|before_ing": "PP_TIME_BEFORE_ING",
    "phrase|prepositional phrase|prep|before_ing": "PP_TIME_BEFORE_ING",
    "phrase|prepositional phrase|modifier|generic": "PP_GENERAL_LINKING",
    "phrase|prepositional phrase|prep|generic": "PP_GENERAL_LINKING",
    "word|auxiliary verb|aux|modal_aux": "WORD_AUX_MODAL",
    "word|auxiliary verb|aux|have_aux": "WORD_AUX_HAVE",
    "word|auxiliary verb|aux|generic": "WORD_AUX_GENERAL",
    "word|verb|root|ing_form": "WORD_VERB_ING",
    "word|verb|dep|ing_form": "WORD_VERB_ING",
    "word|verb|root|participle_form": "WORD_VERB_PARTICIPLE",
    "word|verb|dep|participle_form": "WORD_VERB_PARTICIPLE",
    "word|verb|root|generic": "WORD_VERB_FINITE",
    "word|verb|dep|generic": "WORD_VERB_FINITE",
    "word|pronoun|poss|possessive": "WORD_PRONOUN_POSSESSIVE",
    "word|noun|dobj|generic": "WORD_NOUN_COMMON",
    "word|noun|pobj|generic": "WORD_NOUN_COMMON",
    "word|noun|object|generic": "WORD_NOUN_COMMON",
    "word|article|det|def_article": "WORD_ARTICLE_DEFINITE",
    "word|preposition|prep|generic": "WORD_PREPOSITION",
    "word|adjective|dep|generic": "WORD_ADJECTIVE",
    "word|adjective|amod|generic": "WORD_ADJECTIVE",
    "word|adverb|dep|generic": "WORD_ADVERB",
    "word|adverb|advmod|generic": "WORD_ADVERB",
}
REGISTRY_L3 = {
    "sentence|sentence": "SENTENCE_FINITE_CLAUSE",
    "phrase|verb phrase": "VP_AUXILIARY",
    "phrase|noun phrase": "NP_DETERMINER_NOUN",
    "phrase|prepositional phrase": "PP_GENERAL_LINKING",
    "word|auxiliary verb": "WORD_AUX_HAVE",
    "word|verb": "WORD_VERB_FINITE",
    "word|pronoun": "WORD_PRONOUN_POSSESSIVE",
    "word|noun": "WORD_NOUN_COMMON",
    "word|proper noun": "WORD_NOUN_COMMON",
    "word|article": "WORD_ARTICLE_DEFINITE",
    "word|preposition": "WORD_PREPOSITION",
    "word|adjective": "WORD_ADJECTIVE",
    "word|adverb": "WORD_ADVERB",
}
REGISTRY_L4 = {"sentence": "SENTENCE_FINITE_CLAUSE", "phrase": "PP_GENERAL_LINKING", "word": "WORD_NOUN_COMMON"}
LEVEL_NAMES = ("L1_EXACT", "L2_DROP_TAM", "L3_LEVEL_POS", "L4_FALLBACK")
#: Names of the word classes.
WORD_CLASS = {"DET": "article", "AUX": "auxiliary verb", "VERB": "verb", "PRON": "pronoun", "ADP": "preposition", "NOUN": "noun", "ADV": "adverb", "CCONJ": "coordinating conjunction"}
WORD_DEP = {"DET": "det", "AUX": "aux", "VERB": "root", "PRON": "poss", "ADP": "prep"}
#: Patterns of notes that are no use.
BAD_NOTE = (r"\bnode[_:\-]?\w*", r"\bpart_of_speech\b", r"\bnode_type\b", r"\bcontent\b", r"^true$", r"^false$", r"^[\W_]+$")
GENERIC_NOTE = (
    r"\bsubordinate clause of concession\b", r"\bsubordinate clause of reason\b", r"\bsubordinate clause of reference\b", r"\bverb-?centred phrase expressing what happens\b", r"\bverb-?centred sentence expressing what happens\b",
    r"\bverb-?centred speech\b", r"\bverb-?centred subject\b", r"\bsimple expression with an initial\b", r"\bsimple note with\b", r"\bshort (educational|linguistic|note)\b", r"\bsensibilisation\b", r"\bemphase\b", r"\bsensation posed\b",
)
#: Patterns that may be found inside a note.
BAD_INSIDE = tuple(p for p in BAD_NOTE + GENERIC_NOTE if not p.startswith("^"))
#: Beginnings of notes that are no use.
BAD_LEAD = (r"^\s*sentence\b", r"^\s*senten[cs]e\b", r"^\s*sensence\b", r"^\s*sensibilis(a|z)tion\b")
#: Words that make a note noise.
NOISE_WORDS = ("node", "content", "part", "speech", "sentence", "phrase", "clause", "none", "null")
#: Patterns of rejected candidates.
STOP_PATTERNS = (
    r"sensibilisation", r"sensibilization", r"sensence", r"nod to", r"none\.?\s*node\s*content", r"\bnode\s*content\b", r"\bnode\s*type\b", r"\bpart\s+of\s+speech\b", r"\bpersona\b", r"\bsensational\b", r"\bsensibilite\b", r"\bsensibilit[aä]t\b",
    r"\bin\s+english\b", r"\bnatural\s+english\b", r"\bbooleans?\b", r"\bjson\s+fragments?\b", r"\bplaceholders?\b", r"\bnode,\s*label\b", r"\bsentence\s*:", r"\bsensitence\b", r"\benglish\b.*\bfrench\b", r"\bacademic\s+and\s+professional\s+development\b",
    r"\bnode\s*[:;]", r"\bmust\b.*\buse\b", r"\bdoes not\b.*\buse\b",
)
#: Terms that crowd a bad candidate.
SPAM_WORDS = ("noun", "verb", "phrase", "sentence", "clause", "word")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with class name, dependency, tense bucket, lexical class."""
    return describe(V.nodes(spark, sf))


def describe(n: DataFrame) -> DataFrame:
    first, p, kind = F.get("toks", F.lit(0)), F.get("pos", F.lit(0)), F.col("type")
    possessive = F.exists("toks", lambda x: x.isin(*V.POSSESSIVES))
    later_ing = F.exists(F.slice("toks", 2, 10_000), lambda x: x.endswith("ing"))
    pos = F.when(kind == "Sentence", "sentence").when(kind == "Word", F.try_element_at(literal_map(WORD_CLASS), p)).when(F.array_contains("pos", "ADP"), "prepositional phrase").when(F.exists("pos", lambda x: x.isin("AUX", "VERB")), "verb phrase").otherwise("noun phrase")
    n = n.withColumn("part_of_speech", pos)
    pos = F.col("part_of_speech")
    dep = F.when(kind == "Sentence", "clause").when(kind == "Word", F.coalesce(F.try_element_at(literal_map(WORD_DEP), p), F.lit("dep"))).when(pos == "prepositional phrase", "prep").when(pos == "verb phrase", "predicate").otherwise("object")
    word = F.when((pos == "auxiliary verb") & first.isin(*V.MODALS), "modal_aux").when((pos == "auxiliary verb") & (first == "have"), "have_aux").when((pos == "article") & (first == "the"), "def_article").when(pos == "pronoun", "possessive").when((pos == "verb") & first.endswith("ing"), "ing_form").when((pos == "verb") & (F.get("tag", F.lit(0)) == "VBN"), "participle_form").otherwise("generic")
    phrase = F.when((pos == "noun phrase") & possessive, "possessive").when((first == "before") & later_ing, "before_ing").otherwise("generic")
    sentence = F.when(first.isin(*TIME_OPENERS), "time_subordinator").when(first.isin(*REASON_OPENERS), "reason_subordinator").when(first.isin(*CONCESSION_OPENERS), "concession_subordinator").otherwise("generic")
    bucket = F.when((F.col("tam") == "modal_perfect") & (kind != "Word"), "modal_perfect").otherwise("none")
    return n.withColumn("dep_label", dep).withColumn("tam2", bucket).withColumn("lex", F.when(kind == "Word", word).when(kind == "Phrase", phrase).otherwise(sentence))


def compatible(template: Column) -> Column:
    """Whether a template suits the node row."""
    kind, pos, first, lex = F.col("type"), F.col("part_of_speech"), F.get("toks", F.lit(0)), F.col("lex")
    sentence = F.when(template == "CLAUSE_SUBORDINATE_CONCESSION", first.isin("although", "though", "even")).when(template == "CLAUSE_SUBORDINATE_REASON", first.isin(*REASON_OPENERS)).when(template == "CLAUSE_SUBORDINATE_TIME", first.isin(*TIME_OPENERS)).otherwise(template == "SENTENCE_FINITE_CLAUSE")
    phrase = (
        F.when(template == "PP_TIME_BEFORE_ING", (pos == "prepositional phrase") & (lex == "before_ing")).when(template == "PP_GENERAL_LINKING", pos == "prepositional phrase").when(template == "NP_POSSESSIVE", (pos == "noun phrase") & (lex == "possessive"))
        .when(template == "NP_DETERMINER_NOUN", pos == "noun phrase").when(template == "VP_MODAL_PERFECT", (pos == "verb phrase") & (F.col("tam2") == "modal_perfect")).when(template.isin("VP_AUXILIARY", "VP_PARTICIPLE"), pos == "verb phrase").otherwise(True)
    )
    participle = F.get("tag", F.lit(0)) == "VBN"
    word = (
        F.when(template == "WORD_AUX_MODAL", (pos == "auxiliary verb") & first.isin(*V.MODALS)).when(template == "WORD_AUX_HAVE", (pos == "auxiliary verb") & (first == "have")).when(template == "WORD_AUX_GENERAL", pos == "auxiliary verb")
        .when(template == "WORD_VERB_ING", (pos == "verb") & first.endswith("ing")).when(template == "WORD_VERB_PARTICIPLE", (pos == "verb") & participle).when(template == "WORD_VERB_FINITE", (pos == "verb") & ~participle)
        .when(template == "WORD_PRONOUN_POSSESSIVE", pos == "pronoun").when(template == "WORD_NOUN_COMMON", pos.isin("noun", "proper noun")).when(template == "WORD_ARTICLE_DEFINITE", pos.isin("article", "determiner") & (first == "the"))
        .when(template == "WORD_PREPOSITION", pos == "preposition").when(template == "WORD_ADJECTIVE", pos == "adjective").when(template == "WORD_ADVERB", pos == "adverb").otherwise(True)
    )
    return template.isNotNull() & F.when(kind == "Sentence", sentence).when(kind == "Phrase", phrase).otherwise(word)


def candidates(n: DataFrame) -> DataFrame:
    """Template of each registry level: literal maps, so no join."""
    level = F.lower("type")
    bar = F.lit("|")
    k1 = F.concat(level, bar, "part_of_speech", bar, "dep_label", bar, "tam2", bar, "lex")
    k2 = F.concat(level, bar, "part_of_speech", bar, "dep_label", bar, "lex")
    k3 = F.concat(level, bar, "part_of_speech")
    for name, registry, key in (("t1", REGISTRY_L1, k1), ("t2", REGISTRY_L2, k2), ("t3", REGISTRY_L3, k3), ("t4", REGISTRY_L4, level)):
        n = n.withColumn(name, F.try_element_at(literal_map(registry), key))
    return n


def template_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """First registry that knows the node, and its template."""
    n = candidates(described(spark, sf))
    hit = F.when(F.col("t1").isNotNull(), LEVEL_NAMES[0]).when(F.col("t2").isNotNull(), LEVEL_NAMES[1]).when(F.col("t3").isNotNull(), LEVEL_NAMES[2]).otherwise(LEVEL_NAMES[3])
    return n.groupBy("type", hit.alias("level"), F.coalesce("t1", "t2", "t3", "t4").alias("template_id")).agg(F.count(F.lit(1)).alias("n"))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """The first compatible template on the way down; how many were refused; L4 without one if none suits."""
    n = candidates(described(spark, sf))
    tries = F.filter(F.array(*[F.struct(F.lit(LEVEL_NAMES[k]).alias("level"), F.col(f"t{k + 1}").alias("id"), compatible(F.col(f"t{k + 1}")).alias("ok")) for k in range(4)]), lambda x: x["id"].isNotNull())
    n = n.withColumn("tries", tries)
    first = F.get(F.filter("tries", lambda x: x["ok"]), F.lit(0))
    known = F.col("pick").isNotNull()
    return n.withColumn("pick", first).select(
        "seq", "preorder", "parent", "type", "content", "part_of_speech", "lex", "toks", F.coalesce(F.col("pick.level"), F.lit(LEVEL_NAMES[3])).alias("level"), F.col("pick.id").alias("template_id"),
        F.when(known, F.size(F.filter("tries", lambda x: ~x["ok"]))).otherwise(F.size("tries")).alias("refused"),
    )


def template_compatible_select(spark: SparkSession, sf: str) -> DataFrame:
    s = selected(spark, sf)
    return s.groupBy("type", "level", "template_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("refused").cast("long")).alias("refused"))


def with_validity(df: DataFrame, note: str) -> DataFrame:
    """df with `valid` and `kind` of a note column; its squeezed text and words are worked out once, all lists of patterns are one."""
    df = V.apart(df, T.squeeze(note).alias("_s"))
    df = V.apart(df, T.tokens("_s").alias("_words")).withColumn("_low", F.lower("_s"))
    noise = F.size(F.filter("_words", lambda w: w.isin(*NOISE_WORDS))) / F.greatest(F.size("_words"), F.lit(1))
    ok = (F.length("_s") >= 12) & (F.size("_words") >= 6) & (noise <= 0.30) & ~T.any_match("_s", BAD_LEAD + BAD_NOTE + GENERIC_NOTE)
    has = lambda *xs: F.col("_low").rlike("|".join(xs))
    kind = F.when(has("tense", "aspect", "voice", "mood", "verb form", "plural", "singular"), "morphological").when(has("subject", "predicate", "object", "clause", "phrase", "sentence", "agreement"), "syntactic").when(has("topic", "context", "cohesion", "register", "emphasis"), "discourse").otherwise("semantic")
    return df.withColumn("valid", ok).withColumn("kind", kind).drop("_s", "_words", "_low")


_BAD = [re.compile(p, re.IGNORECASE | re.ASCII) for p in BAD_LEAD + BAD_NOTE + GENERIC_NOTE]


def is_valid(note: str) -> bool:
    """The same verdict on one squeezed ASCII text, for fixed values."""
    words = re.findall("[a-z']+", note.lower())
    bad = any(p.search(note) for p in _BAD)
    return len(note) >= 12 and len(words) >= 6 and sum(w in NOISE_WORDS for w in words) / len(words) <= 0.30 and not bad


def clean_candidate(text: Column) -> Column:
    """Straight quotes, single spaces, no space before marks, single dots.  ASCII input; see providers for NFKC."""
    out = F.translate(text, "“”‘’", "\"\"''")
    out = F.regexp_replace(T.squeeze(out), r"\s+([.,:;!?])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"[.\s]+$", ".")
    return F.trim(out)


def unsound(low: Column, kind: Column, pos: Column, content: Column) -> Column:
    """Whether a lower-cased text says something that its node cannot be."""
    before_after = (F.lower(pos) == "prepositional phrase") & F.lower(content).rlike("^(before|after) ")
    return (F.lower(kind).isin("word", "phrase") & F.contains(low, F.lit("subordinate clause"))) | (before_after & low.rlike("concession|reason"))


def keep_candidate(text: Column, allow_sentences: tuple[str, ...] = (), allow_short: tuple[str, ...] = (), least: int = 5, node: tuple[Column, Column, Column] | None = None) -> Column:
    """Whether a cleaned candidate is kept; allowed keys (lower case, without end dots) pass the rules on sentence labels and on length; node: type, class, content."""
    low = F.lower(text)
    key = F.regexp_replace(low, r"[.\s]+$", "")
    sentence_ok = key.isin(*[x.lower() for x in allow_sentences]) if allow_sentences else F.lit(False)
    short_ok = key.isin(*[x.lower() for x in allow_short]) if allow_short else F.lit(False)
    words = T.tokens(text)
    n = F.size(words)
    repeats = (n >= 10) & ((F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)) < 0.45) | (F.size(F.filter(words, lambda w: w.isin(*SPAM_WORDS))) / F.greatest(n, F.lit(1)) > 0.35))
    labels = F.regexp_count(low, F.lit(r"\b(node|form|tense|word|pos|type)\s*[:;]")) >= 3
    sane = ~unsound(low, *node) if node else F.lit(True)
    stopped = T.any_match(text, STOP_PATTERNS) & ~(sentence_ok & low.rlike(r"^\s*sentence\s*:"))
    return (text != "") & ~stopped & ~repeats & ~labels & (~low.rlike(r"^\s*senten(?:ce|se)\b") | sentence_ok) & ((F.length(text) >= least) | short_ok) & F.coalesce(sane, F.lit(True))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).select("seq", "source", "text")
    k = F.col("seq") % 5
    noisy = F.when(k == 0, F.concat("text", F.lit(" .."))).when(k == 1, F.concat(F.lit("Sentence: "), "text")).when(k == 2, F.concat("text", F.lit(" node content"))).when(k == 3, F.concat(F.lit("“"), "text", F.lit("” ."))).otherwise(F.col("text"))
    # Generated, so that a filter on the text is not pushed below its cleaning, which would then run for each of its uses.
    return s.select("seq", "source", F.explode(F.array(clean_candidate(noisy))).alias("text"))


#: Fixture: keys that pass although they look like labels or are short.
ALLOW_SENTENCES, ALLOW_SHORT = ("sentence: finite clause",), ("go", "ox")
_NODE_CANDIDATE = "CASE (seq + preorder) % 7 WHEN 0 THEN 'Sentence: finite clause.' WHEN 1 THEN 'Sentence: of ' || content WHEN 2 THEN content WHEN 3 THEN 'A subordinate clause about ' || content WHEN 4 THEN 'It gives the reason for ' || content WHEN 5 THEN 'go' ELSE 'ab' END"


def rejected_candidate_node_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates judged with their node and with allowed keys: kept and dropped by type and class."""
    d = described(spark, sf).select("type", "part_of_speech", "content", clean_candidate(F.expr(_NODE_CANDIDATE)).alias("text"))
    keep = keep_candidate(F.col("text"), ALLOW_SENTENCES, ALLOW_SHORT, node=(F.col("type"), F.col("part_of_speech"), F.col("content")))
    judged = d.select("type", "part_of_speech", keep.alias("keep"))
    return judged.groupBy("type", "part_of_speech").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def rejected_candidate_keep(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf).select("source", keep_candidate(F.col("text")).alias("keep"))
    return c.groupBy("source").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"))


def rejected_candidate_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Kept candidates by key (lower, without end dots): first text, count, sources in order."""
    c = _candidates(spark, sf).where(keep_candidate(F.col("text")))
    key = F.lower(F.regexp_replace("text", r"[.\s]+$", ""))
    g = c.groupBy(key.alias("key")).agg(F.min_by("text", "seq").alias("text"), F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("seq").alias("first_seq"))
    return g.select("text", "count", F.array_join("sources", ",").alias("sources"), "first_seq")


def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Texts seen at least twice, the 50 most frequent: the list's own limit."""
    s = V.sentences(spark, sf).select("seq", T.squeeze("text").alias("text")).union(V.read(spark, sf, "benchmark").select(F.col("item_id"), T.squeeze("text")))
    g = s.groupBy("text").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first")).where("count >= 2")
    return g.orderBy(F.desc("count"), "first", "text").limit(50).select("text", "count")


QUERIES = {f.__name__: f for f in (
    template_cascade, template_compatible_select, rejected_candidate_keep, rejected_candidate_node_rules, rejected_candidate_stats, hard_negatives,
)}

_POSS, _MOD = V.sql_list(V.POSSESSIVES), V.sql_list(V.MODALS)
_CASE = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
DESCRIBED = V.NODES + f""",
d1 AS (SELECT *, CASE WHEN type = 'Sentence' THEN 'sentence' WHEN type = 'Word' THEN {_CASE('pos[1]', WORD_CLASS)} WHEN list_contains(pos, 'ADP') THEN 'prepositional phrase' WHEN list_has_any(pos, ['AUX', 'VERB']) THEN 'verb phrase' ELSE 'noun phrase' END AS part_of_speech FROM nodes),
described AS (SELECT *, CASE WHEN type = 'Sentence' THEN 'clause' WHEN type = 'Word' THEN coalesce({_CASE('pos[1]', WORD_DEP)}, 'dep') WHEN part_of_speech = 'prepositional phrase' THEN 'prep' WHEN part_of_speech = 'verb phrase' THEN 'predicate' ELSE 'object' END AS dep_label,
  CASE WHEN tam = 'modal_perfect' AND type <> 'Word' THEN 'modal_perfect' ELSE 'none' END AS tam2,
  CASE WHEN type = 'Word' THEN CASE WHEN part_of_speech = 'auxiliary verb' AND toks[1] IN ({_MOD}) THEN 'modal_aux' WHEN part_of_speech = 'auxiliary verb' AND toks[1] = 'have' THEN 'have_aux' WHEN toks[1] = 'the' THEN 'def_article'
      WHEN part_of_speech = 'pronoun' THEN 'possessive' WHEN part_of_speech = 'verb' AND suffix(toks[1], 'ing') THEN 'ing_form' WHEN part_of_speech = 'verb' AND tag[1] = 'VBN' THEN 'participle_form' ELSE 'generic' END
    WHEN type = 'Phrase' THEN CASE WHEN part_of_speech = 'noun phrase' AND list_has_any(toks, [{_POSS}]) THEN 'possessive' WHEN toks[1] = 'before' AND len(list_filter(toks[2:], lambda x: suffix(x, 'ing'))) > 0 THEN 'before_ing' ELSE 'generic' END
    ELSE CASE WHEN toks[1] IN ('before', 'after', 'when', 'while') THEN 'time_subordinator' WHEN toks[1] IN ('because', 'since', 'as') THEN 'reason_subordinator' WHEN toks[1] IN ('although', 'though') THEN 'concession_subordinator' ELSE 'generic' END END AS lex FROM d1)"""
_VALUES = lambda name, m: f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in m.items()) + ") t(k, id))"
CANDIDATES = DESCRIBED + ", " + ", ".join(_VALUES(n, m) for n, m in (("r1", REGISTRY_L1), ("r2", REGISTRY_L2), ("r3", REGISTRY_L3), ("r4", REGISTRY_L4))) + """,
cand AS (SELECT d.*, r1.id AS t1, r2.id AS t2, r3.id AS t3, r4.id AS t4 FROM described d LEFT JOIN r1 ON r1.k = lower(type) || '|' || part_of_speech || '|' || dep_label || '|' || tam2 || '|' || lex
  LEFT JOIN r2 ON r2.k = lower(type) || '|' || part_of_speech || '|' || dep_label || '|' || lex LEFT JOIN r3 ON r3.k = lower(type) || '|' || part_of_speech LEFT JOIN r4 ON r4.k = lower(type))"""
_OK = f"""(CASE type WHEN 'Sentence' THEN CASE id WHEN 'CLAUSE_SUBORDINATE_CONCESSION' THEN toks[1] IN ('although', 'though', 'even') WHEN 'CLAUSE_SUBORDINATE_REASON' THEN toks[1] IN ('because', 'since', 'as')
    WHEN 'CLAUSE_SUBORDINATE_TIME' THEN toks[1] IN ('before', 'after', 'when', 'while') ELSE id = 'SENTENCE_FINITE_CLAUSE' END
  WHEN 'Phrase' THEN CASE id WHEN 'PP_TIME_BEFORE_ING' THEN part_of_speech = 'prepositional phrase' AND lex = 'before_ing' WHEN 'PP_GENERAL_LINKING' THEN part_of_speech = 'prepositional phrase' WHEN 'NP_POSSESSIVE' THEN part_of_speech = 'noun phrase' AND lex = 'possessive'
    WHEN 'NP_DETERMINER_NOUN' THEN part_of_speech = 'noun phrase' WHEN 'VP_MODAL_PERFECT' THEN part_of_speech = 'verb phrase' AND tam2 = 'modal_perfect' WHEN 'VP_AUXILIARY' THEN part_of_speech = 'verb phrase' ELSE true END
  ELSE CASE id WHEN 'WORD_AUX_MODAL' THEN lex = 'modal_aux' WHEN 'WORD_AUX_HAVE' THEN part_of_speech = 'auxiliary verb' AND toks[1] = 'have' WHEN 'WORD_AUX_GENERAL' THEN part_of_speech = 'auxiliary verb' WHEN 'WORD_VERB_ING' THEN part_of_speech = 'verb' AND suffix(toks[1], 'ing')
    WHEN 'WORD_VERB_PARTICIPLE' THEN part_of_speech = 'verb' AND tag[1] = 'VBN' WHEN 'WORD_VERB_FINITE' THEN part_of_speech = 'verb' AND tag[1] <> 'VBN' WHEN 'WORD_PRONOUN_POSSESSIVE' THEN part_of_speech = 'pronoun' WHEN 'WORD_NOUN_COMMON' THEN part_of_speech = 'noun'
    WHEN 'WORD_ARTICLE_DEFINITE' THEN toks[1] = 'the' WHEN 'WORD_PREPOSITION' THEN part_of_speech = 'preposition' WHEN 'WORD_ADVERB' THEN part_of_speech = 'adverb' ELSE true END END)"""
SELECTED = CANDIDATES + f""",
tries AS (SELECT seq, preorder, parent, type, toks, tag, part_of_speech, lex, tam2, k, id FROM (SELECT *, 1 AS k, t1 AS id FROM cand UNION ALL SELECT *, 2, t2 FROM cand UNION ALL SELECT *, 3, t3 FROM cand UNION ALL SELECT *, 4, t4 FROM cand) WHERE id IS NOT NULL),
judged AS (SELECT *, {_OK} AS ok FROM tries),
selected AS (SELECT seq, preorder, parent, any_value(type) AS type, ['L1_EXACT', 'L2_DROP_TAM', 'L3_LEVEL_POS', 'L4_FALLBACK'][coalesce(min(k) FILTER (ok), 4)] AS level, arg_min(id, k) FILTER (ok) AS template_id, count(*) FILTER (NOT ok) AS refused FROM judged GROUP BY seq, preorder, parent)"""
_RX = lambda ps, c: " OR ".join("regexp_matches({}, '(?i){}')".format(c, p.replace("'", "''")) for p in ps)
_VALID = f"""(t <> '' AND NOT ({_RX(BAD_LEAD, 't')}) AND length(t) >= 12 AND len(ws) >= 6 AND NOT ({_RX(BAD_NOTE, 't')}) AND len(list_filter(ws, lambda w: w IN ({V.sql_list(NOISE_WORDS)}))) / greatest(len(ws), 1) <= 0.30 AND NOT ({_RX(GENERIC_NOTE, 't')}))"""
#: A candidate's verdict in SQL: of text and its words ws.
_KEEP = lambda stop, head, least: f"text <> '' AND NOT (({_RX(STOP_PATTERNS, 'text')}){stop}) AND NOT (len(ws) >= 10 AND (len(list_distinct(ws)) / len(ws) < 0.45 OR len(list_filter(ws, lambda w: w IN ({V.sql_list(SPAM_WORDS)}))) / len(ws) > 0.35)) AND len(regexp_extract_all(lower(text), '\\b(node|form|tense|word|pos|type)\\s*[:;]')) < 3 AND (NOT regexp_matches(lower(text), '^\\s*senten(?:ce|se)\\b'){head}) AND {least}"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '\s+([.,:;!?])', '\1', 'g'), '\.{{2,}}', '.', 'g'), '[.\s]+$', '.'))"
_KEY_IN = lambda xs: f"regexp_replace(lower(text), '[.\\s]+$', '') IN ({V.sql_list(xs)})"
_CANDS = V.SENTENCES + r""",
noisy AS (SELECT seq, source, CASE seq % 5 WHEN 0 THEN text || ' ..' WHEN 1 THEN 'Sentence: ' || text WHEN 2 THEN text || ' node content' WHEN 3 THEN '"' || text || '" .' ELSE text END AS t FROM sentences),
c AS (SELECT seq, source, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '\s+([.,:;!?])', '\1', 'g'), '\.{2,}', '.', 'g'), '[.\s]+$', '.')) AS text FROM noisy),
cw AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM c),""" + rf"""
kept AS (SELECT *, text <> '' AND NOT ({_RX(STOP_PATTERNS, 'text')}) AND NOT (len(ws) >= 10 AND (len(list_distinct(ws)) / len(ws) < 0.45 OR len(list_filter(ws, lambda w: w IN ({V.sql_list(SPAM_WORDS)}))) / len(ws) > 0.35))
  AND len(regexp_extract_all(lower(text), '\b(node|form|tense|word|pos|type)\s*[:;]')) < 3 AND NOT regexp_matches(lower(text), '^\s*senten(?:ce|se)\b') AND length(text) >= 5 AS keep FROM cw)"""

ORACLES = {
    "template_cascade": V.sql(CANDIDATES, "SELECT type, CASE WHEN t1 IS NOT NULL THEN 'L1_EXACT' WHEN t2 IS NOT NULL THEN 'L2_DROP_TAM' WHEN t3 IS NOT NULL THEN 'L3_LEVEL_POS' ELSE 'L4_FALLBACK' END AS level, coalesce(t1, t2, t3, t4) AS template_id, count(*) AS n FROM cand GROUP BY 1, 2, 3"),
    "template_compatible_select": V.sql(SELECTED, "SELECT type, level, template_id, count(*) AS n, CAST(sum(refused) AS BIGINT) AS refused FROM selected GROUP BY 1, 2, 3"),
    "rejected_candidate_node_rules": V.sql(DESCRIBED, f""", c0 AS (SELECT type, part_of_speech, content, {_CLEAN.format(_NODE_CANDIDATE)} AS text FROM described), c AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM c0),
      k AS (SELECT *, {_KEEP(f" AND NOT ({_KEY_IN(ALLOW_SENTENCES)} AND regexp_matches(lower(text), '^sentence *:'))", f" OR {_KEY_IN(ALLOW_SENTENCES)}", f"(length(text) >= 5 OR {_KEY_IN(ALLOW_SHORT)})")}
        AND NOT ((type IN ('Word', 'Phrase') AND contains(lower(text), 'subordinate clause')) OR (part_of_speech = 'prepositional phrase' AND regexp_matches(content, '^(before|after) ') AND regexp_matches(lower(text), 'concession|reason'))) AS keep FROM c)
      SELECT type, part_of_speech, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM k GROUP BY 1, 2"""),
    "rejected_candidate_keep": V.sql(_CANDS, "SELECT source, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM kept GROUP BY source"),
    "rejected_candidate_stats": V.sql(_CANDS, r"SELECT arg_min(text, seq) AS text, count(*) AS count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(seq) AS first_seq FROM kept WHERE keep GROUP BY lower(regexp_replace(text, '[.\s]+$', ''))"),
    "hard_negatives": V.sql(V.SENTENCES, r""", u AS (SELECT seq, text AS t FROM sentences UNION ALL SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) FROM benchmark)
      SELECT t AS text, count(*) AS count FROM u GROUP BY t HAVING count(*) >= 2 ORDER BY count(*) DESC, min(seq), t LIMIT 50"""),
}
