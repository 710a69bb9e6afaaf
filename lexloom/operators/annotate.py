"""Notes of nodes: rendered templates, fallback notes, suitability, typed notes, traces and flags of the note modes.

Expressions that Spark and the checking SQL share read the same columns: type, part_of_speech, content, tense, lead
(first token), n_words, and of a selection template_id, matched_key, level.  Whether a note is new in its sentence is
a first occurrence by (sentence, note), so a sentence's nodes are ranked, never folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..plans import views as V
from . import notes

#: Five wordings of each template; {content} is the node's text.
TEMPLATE_VARIANTS = {
    "SENTENCE_FINITE_CLAUSE": (
        "This sentence forms a finite clause that expresses a complete proposition.", "The sentence is a finite clause with a complete clause-level meaning.", "This sentence functions as a complete finite clause in context.",
        "This sentence encodes a full proposition through a finite clause structure.", "The sentence presents a complete finite clause with one main proposition.",
    ),
    "CLAUSE_SUBORDINATE_TIME": (
        "This sentence contains a time subclause that situates the main event.", "The sentence uses a subordinate time relation to anchor the event.", "This sentence marks temporal sequencing through a subordinate clause.",
        "A subordinate time clause organizes when the main event is interpreted.", "This sentence includes a temporal subclause that frames the main clause.",
    ),
    "CLAUSE_SUBORDINATE_REASON": (
        "This sentence includes a subordinate clause that expresses a reason.", "A reason subclause explains why the main event holds.", "This sentence marks causation through a subordinate reason clause.",
        "The clause structure contains a reason relation for the main event.", "A subordinate reason clause provides motivation for the main statement.",
    ),
    "CLAUSE_SUBORDINATE_CONCESSION": (
        "This sentence uses a concessive subclause contrasting with the main clause.", "A subordinate concession clause introduces contrast to the main event.", "This sentence marks concession while preserving the main-clause claim.",
        "The clause structure includes a concessive relation to the main statement.", "A concession subclause adds contrast against the core clause meaning.",
    ),
    "VP_MODAL_PERFECT": (
        "The phrase '{content}' is a verb phrase with modal meaning and perfect aspect.", "This phrase uses a modal plus perfect construction in the verbal group.", "The phrase '{content}' marks modality through a perfect verb phrase pattern.",
        "This verb phrase combines a modal auxiliary with a perfect construction.", "The phrase '{content}' is a modal-perfect verb phrase in clause structure.",
    ),
    "VP_AUXILIARY": (
        "The phrase '{content}' is a verb phrase supported by an auxiliary pattern.", "This phrase functions as a verb phrase with auxiliary-driven verbal structure.", "The phrase '{content}' forms a verb phrase centered on auxiliary support.",
        "This verb phrase uses an auxiliary to organize verbal grammar.", "The phrase '{content}' is a verbal phrase with auxiliary structure.",
    ),
    "VP_PARTICIPLE": (
        "The phrase '{content}' is a verb phrase built around a participle form.", "This phrase functions as a participial verb phrase in context.", "The phrase '{content}' uses a participle as the verbal center.",
        "This verb phrase is organized around participial verbal morphology.", "The phrase '{content}' forms a participle-based verbal phrase.",
    ),
    "NP_POSSESSIVE": (
        "The phrase '{content}' is a noun phrase with a possessive relation.", "This phrase functions as a possessive noun phrase in the clause.", "The phrase '{content}' marks possession inside a noun phrase.",
        "This noun phrase uses a possessive element to identify reference.", "The phrase '{content}' forms a possessive noun phrase pattern.",
    ),
    "NP_DETERMINER_NOUN": (
        "The phrase '{content}' is a noun phrase built from determiner and noun.", "This phrase functions as a noun phrase with a nominal head.", "The phrase '{content}' forms a determiner-plus-noun phrase pattern.",
        "This noun phrase combines nominal reference with phrase-level structure.", "The phrase '{content}' is a noun phrase centered on a noun head.",
    ),
    "PP_TIME_BEFORE_ING": (
        "The phrase '{content}' marks time with 'before' plus an -ing form.", "This phrase is a time prepositional phrase built with 'before' and -ing.", "The phrase '{content}' introduces temporal sequencing via 'before' + V-ing.",
        "This prepositional phrase uses 'before' to mark time relation in the clause.", "The phrase '{content}' functions as a temporal prepositional modifier.",
    ),
    "PP_GENERAL_LINKING": (
        "The phrase '{content}' is a prepositional phrase linking a complement to the clause.", "This phrase functions as a prepositional linker inside sentence structure.", "The phrase '{content}' introduces a relation through prepositional structure.",
        "This prepositional phrase connects a complement to another clause element.", "The phrase '{content}' acts as a prepositional modifier in context.",
    ),
    "WORD_AUX_MODAL": (
        "'{content}' is a modal auxiliary expressing stance or obligation in the verb phrase.", "'{content}' functions as a modal auxiliary in the verbal group.", "As a word, '{content}' is a modal auxiliary supporting verb meaning.",
        "'{content}' is an auxiliary modal that marks speaker-oriented modality.", "This word, '{content}', is a modal auxiliary within clause grammar.",
    ),
    "WORD_AUX_HAVE": (
        "'{content}' is auxiliary 'have' supporting a perfect verbal construction.", "This word, '{content}', functions as perfect auxiliary 'have'.", "'{content}' serves as auxiliary 'have' in the verbal group.",
        "As a word, '{content}' marks perfect construction through auxiliary use.", "'{content}' is an auxiliary form of 'have' in clause structure.",
    ),
    "WORD_AUX_GENERAL": (
        "'{content}' is an auxiliary verb supporting tense, aspect, mood, or voice.", "This word, '{content}', functions as an auxiliary in the verbal group.", "'{content}' supports clause grammar as an auxiliary verb form.",
        "As a word, '{content}' is an auxiliary that helps structure the verb phrase.", "'{content}' serves as an auxiliary verb in this construction.",
    ),
    "WORD_VERB_PARTICIPLE": (
        "'{content}' is a participle verb form in the verbal construction.", "This word, '{content}', functions as a participial verb form.", "'{content}' contributes participle morphology to the verb group.",
        "As a word, '{content}' is a participle in clause-level verbal grammar.", "'{content}' is used as a participial verb element in context.",
    ),
    "WORD_PRONOUN_POSSESSIVE": (
        "'{content}' is a possessive pronoun or determiner in a noun phrase.", "This word, '{content}', marks possession inside the noun phrase.", "'{content}' functions as a possessive form modifying nominal reference.",
        "As a word, '{content}' contributes possessive reference in the phrase.", "'{content}' is a possessive pronoun/determiner in clause structure.",
    ),
    "WORD_NOUN_COMMON": (
        "'{content}' is a common noun naming an entity in context.", "This word, '{content}', functions as a common noun in the clause.", "'{content}' serves as a noun that introduces lexical reference.",
        "As a word, '{content}' is a common noun with nominal function.", "'{content}' contributes entity reference as a common noun.",
    ),
    "WORD_ARTICLE_DEFINITE": (
        "'{content}' is the definite article introducing an identifiable noun reference.", "This word, '{content}', functions as a definite determiner.", "'{content}' marks definiteness for the following noun phrase.",
        "As a word, '{content}' is a definite article in nominal structure.", "'{content}' contributes definite reference in the noun phrase.",
    ),
    "WORD_PREPOSITION": (
        "'{content}' is a preposition linking a complement to another element.", "This word, '{content}', functions as a prepositional linker in the clause.", "'{content}' introduces a prepositional relation in context.",
        "As a word, '{content}' is a preposition connecting phrase elements.", "'{content}' serves as a preposition in clause-level structure.",
    ),
    "WORD_VERB_ING": (
        "'{content}' is an -ing verb form with non-finite function.", "This word, '{content}', functions as a non-finite -ing verb form.", "'{content}' contributes an -ing verbal form to the phrase.",
        "As a word, '{content}' is an -ing form in non-finite verb use.", "'{content}' is used as a gerund-participle form in context.",
    ),
    "WORD_VERB_FINITE": (
        "'{content}' is a finite verb form functioning as part of the clause predicate.", "This word, '{content}', functions as a finite verb in clause structure.", "'{content}' contributes finite verbal meaning to the clause.",
        "As a word, '{content}' is a finite verb form in context.", "'{content}' serves as a finite verb in the sentence.",
    ),
    "WORD_ADJECTIVE": (
        "'{content}' is an adjective describing a noun or complement in context.", "This word, '{content}', functions as an adjective in the clause.", "'{content}' contributes descriptive adjectival meaning in the phrase.",
        "As a word, '{content}' is an adjective with modifying function.", "'{content}' serves as an adjective in sentence structure.",
    ),
    "WORD_ADVERB": (
        "'{content}' is an adverb modifying a verb, adjective, or clause element.", "This word, '{content}', functions as an adverb in context.", "'{content}' contributes adverbial meaning to the clause.",
        "As a word, '{content}' is an adverb with modifying function.", "'{content}' serves as an adverbial modifier in the sentence.",
    ),
}
#: Wordings of a finite clause in the modal perfect.
MODAL_PERFECT_VARIANTS = (
    "This sentence uses a modal perfect form to express regret or criticism about a past unrealized action.", "The sentence shows modal perfect meaning, often evaluating what should have happened in the past.",
    "This sentence encodes modal perfect interpretation about a past action that did not occur as expected.",
)
#: Fallback notes of sentences, phrases and words; {content}, {tense} and {count} stand for the node's.
SENTENCE_TENSE, SENTENCE_PLAIN = "This sentence expresses a complete proposition and is anchored in {tense} time reference, with about {count} lexical items.", "This sentence expresses a complete proposition with finite clause structure and about {count} lexical items."
PHRASE_NOTES = {
    "determiner": "The phrase '{content}' is a noun phrase with an explicit determiner, marking a participant or referential entity.", "noun phrase": "The phrase '{content}' functions as a noun phrase marking a participant or referential entity.",
    "tense": "The phrase '{content}' is a verb phrase encoding an action/state with {tense} temporal interpretation.", "verb phrase": "The phrase '{content}' is a verb phrase encoding an action or state.",
    "prepositional phrase": "The phrase '{content}' is a prepositional phrase introducing relational context such as location, time, or semantic linkage.",
    "other": "The phrase '{content}' contributes phrasal structure that supports sentence-level interpretation and information packaging.",
}
ARTICLE_NOTES = {"the": "'{content}' is the definite article, signaling a specific or identifiable noun reference.", "a": "'{content}' is an indefinite article, introducing a nonspecific countable noun reference.", "an": "'{content}' is an indefinite article, introducing a nonspecific countable noun reference."}
VERB_NOTES = {
    "past": "'{content}' is a past-form verb that presents the event as completed in prior time.", "present": "'{content}' is a present-form verb expressing an action or state in current relevance.", "past participle": "'{content}' is a past participle that often contributes perfect or passive verbal constructions.",
    "present participle": "'{content}' is a present participle that can mark progressive aspect or modifier function.", "participle": "'{content}' is a participial verb form contributing non-finite verbal meaning.",
}
PREPOSITION_NOTES = {
    "in": "'{content}' is a preposition marking containment or location within a bounded context.", "on": "'{content}' is a preposition marking surface contact or supported spatial relation.", "at": "'{content}' is a preposition marking a point-like location or temporal anchor.",
    "to": "'{content}' is a preposition marking direction, goal, or recipient relation.", "from": "'{content}' is a preposition marking source, origin, or starting point relation.", "with": "'{content}' is a preposition marking accompaniment, instrument, or associative relation.",
    "by": "'{content}' is a preposition marking agency, means, or proximity relation.", "of": "'{content}' is a preposition marking dependency, composition, or possessive relation.",
}
WORD_NOTES = {
    "article": "'{content}' is an article used to specify or determine a related noun.", "noun": "'{content}' is a noun that names an entity, concept, or object in context.", "proper noun": "'{content}' is a proper noun referring to a specific named entity.",
    "pronoun": "'{content}' is a pronoun used to refer to an entity without repeating a full noun phrase.", "verb": "'{content}' is a verb form that contributes core action or state meaning.", "auxiliary verb": "'{content}' is an auxiliary verb that supports verbal grammar, modality, or voice interpretation.",
    "adjective": "'{content}' is an adjective that modifies a noun by adding descriptive information.", "adverb": "'{content}' is an adverb that modifies a verb, adjective, or clause-level meaning.", "preposition": "'{content}' is a preposition that links a noun phrase to another sentence element.",
    "coordinating conjunction": "'{content}' is a coordinating conjunction that joins parallel elements.", "subordinating conjunction": "'{content}' is a subordinating conjunction introducing a dependent clause.", "particle": "'{content}' functions as a particle that refines a verb or clause meaning.",
    "numeral": "'{content}' is a numeral expressing quantity or order.", "interjection": "'{content}' is an interjection expressing immediate attitude or reaction.", "punctuation": "'{content}' is punctuation marking structure, boundaries, or discourse rhythm.",
}
WORD_OTHER, OTHER_NOTE = "'{content}' is a lexical item contributing grammatical and semantic information in context.", "This element contributes to the sentence structure and interpreted meaning."
#: Classes whose nodes carry tense.
TAM_CLASSES = ("verb phrase", "clause", "verb", "auxiliary verb")
NOTE_MODES = ("template_only", "two_stage")


def _said(wording: str) -> str:
    """A wording as an expression."""
    out = "'" + wording.replace("'", "''") + "'"
    for name, column in (("content", "content"), ("tense", "tense"), ("count", "CAST(n_words AS STRING)")):
        out = out.replace("{" + name + "}", f"' || {column} || '")
    return "(" + out + ")"


def _pick(column: str, values: dict[str, str], otherwise: str = "") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_said(v)}" for k, v in values.items()) + (f" ELSE {otherwise}" if otherwise else "") + " END"


_TENSED = "coalesce(tense, '') NOT IN ('', 'null')"
#: The same in SQL.
FALLBACK = f"""CASE type WHEN 'Sentence' THEN CASE WHEN {_TENSED} THEN {_said(SENTENCE_TENSE)} ELSE {_said(SENTENCE_PLAIN)} END
  WHEN 'Phrase' THEN CASE WHEN part_of_speech LIKE '%noun phrase%' AND lead IN ('a', 'an', 'the') THEN {_said(PHRASE_NOTES['determiner'])} WHEN part_of_speech LIKE '%noun phrase%' THEN {_said(PHRASE_NOTES['noun phrase'])}
    WHEN part_of_speech LIKE '%verb phrase%' AND {_TENSED} THEN {_said(PHRASE_NOTES['tense'])} WHEN part_of_speech LIKE '%verb phrase%' THEN {_said(PHRASE_NOTES['verb phrase'])} WHEN part_of_speech LIKE '%prepositional phrase%' THEN {_said(PHRASE_NOTES['prepositional phrase'])} ELSE {_said(PHRASE_NOTES['other'])} END
  WHEN 'Word' THEN coalesce(CASE part_of_speech WHEN 'article' THEN {_pick('lower(content)', ARTICLE_NOTES)} WHEN 'verb' THEN {_pick('tense', VERB_NOTES)} WHEN 'preposition' THEN {_pick('lower(content)', PREPOSITION_NOTES)} END, {_pick('part_of_speech', WORD_NOTES, _said(WORD_OTHER))})
  ELSE {_said(OTHER_NOTE)} END"""
_MODAL_PERFECT = "template_id = 'SENTENCE_FINITE_CLAUSE' AND tam2 = 'modal_perfect'"
RENDERED = (
    f"CASE WHEN {_MODAL_PERFECT} THEN CASE variant % {len(MODAL_PERFECT_VARIANTS)} " + " ".join(f"WHEN {i} THEN {_said(v)}" for i, v in enumerate(MODAL_PERFECT_VARIANTS)) + " END ELSE CASE template_id "
    + " ".join(f"WHEN '{t}' THEN CASE variant % {len(vs)} " + " ".join(f"WHEN {i} THEN {_said(v)}" for i, v in enumerate(vs)) + " END" for t, vs in TEMPLATE_VARIANTS.items()) + " END END"
)
_HASHED = "template_id || '|' || lower(content) || '|' || coalesce(matched_key, '')"
#: Whether a note says something that its node cannot be.
UNSOUND = "((type IN ('Word', 'Phrase') AND {0} LIKE '%subordinate clause%') OR (part_of_speech = 'prepositional phrase' AND (content LIKE 'before %' OR content LIKE 'after %') AND ({0} LIKE '%concession%' OR {0} LIKE '%reason%')))"
#: Whether a valid note suits its node: words are quoted, phrases and sentences named, a phrase anchored by one of its first two longer words, no tense contradicted.
SUITABLE = (
    "(NOT " + UNSOUND + " AND CASE type WHEN 'Word' THEN content = '' OR contains({0}, '''' || content || '''') WHEN 'Phrase' THEN contains({0}, 'phrase') AND (long1 IS NULL OR contains({0}, long1) OR (long2 IS NOT NULL AND contains({0}, long2))) "
    "WHEN 'Sentence' THEN contains({0}, 'sentence') AND NOT (coalesce(tense, '') = 'past' AND contains({0}, 'present simple')) AND NOT (coalesce(tense, '') = 'present' AND contains({0}, 'past simple')) ELSE true END)"
)
#: A note's kind: by its template's prefix, else by what it says.
KIND = (
    "CASE WHEN {1} LIKE 'WORD\\_%' {esc} THEN 'morphological' WHEN {1} <> '' THEN 'syntactic' WHEN {rx}({0}, 'tense|aspect|voice|mood|verb form|plural|singular') THEN 'morphological' "
    "WHEN {rx}({0}, 'subject|predicate|object|clause|phrase|sentence|agreement') THEN 'syntactic' WHEN {rx}({0}, 'topic|context|cohesion|register|emphasis') THEN 'discourse' ELSE 'semantic' END"
).replace("LIKE 'WORD\\_%' {esc}", "LIKE 'WORD%'")


def _looked_up(values: dict[str, str], key: Column) -> Column:
    """A wording by its key: one literal map, however many wordings there are."""
    return F.try_element_at(notes.literal_map(values), key)


def filled(wording: Column) -> Column:
    """A wording with the node's text, tense and number of words in their places."""
    out = F.replace(wording, F.lit("{content}"), F.col("content"))
    return F.replace(F.replace(out, F.lit("{tense}"), F.coalesce("tense", F.lit(""))), F.lit("{count}"), F.col("n_words").cast("string"))


def fallback_wording() -> Column:
    """The wording of a rule-made note, by type, class, tense and text."""
    kind, pos = F.col("type"), F.col("part_of_speech")
    tensed, low = ~F.coalesce("tense", F.lit("")).isin("", "null"), F.lower("content")
    has = lambda name: F.contains(pos, F.lit(name))
    which = (
        F.when(has("noun phrase") & F.col("lead").isin("a", "an", "the"), "determiner").when(has("noun phrase"), "noun phrase").when(has("verb phrase") & tensed, "tense").when(has("verb phrase"), "verb phrase")
        .when(has("prepositional phrase"), "prepositional phrase").otherwise("other")
    )
    own = F.when(pos == "article", _looked_up(ARTICLE_NOTES, low)).when(pos == "verb", _looked_up(VERB_NOTES, F.coalesce("tense", F.lit("")))).when(pos == "preposition", _looked_up(PREPOSITION_NOTES, low))
    word = F.coalesce(own, _looked_up(WORD_NOTES, pos), F.lit(WORD_OTHER))
    sentence = F.when(tensed, SENTENCE_TENSE).otherwise(SENTENCE_PLAIN)
    return F.when(kind == "Sentence", sentence).when(kind == "Phrase", _looked_up(PHRASE_NOTES, which)).when(kind == "Word", word).otherwise(OTHER_NOTE)


def fallback_note() -> Column:
    """A rule-made note from type, class, tense and text."""
    return filled(fallback_wording())


def sound_wordings() -> list[str]:
    """Wordings of words' rule-made notes that are valid whatever word they quote, if the word itself holds no bad pattern.

    The word is one run of letters and apostrophes and the quotes make it no noise word; no pattern matches a quote, so one that is found is found in the wording, judged here, or in the word.
    """
    every = {WORD_OTHER, *(w for said in (ARTICLE_NOTES, VERB_NOTES, PREPOSITION_NOTES, WORD_NOTES) for w in said.values())}
    return sorted(w for w in every if w.count("{") == 1 and "'{content}'" in w and notes.is_valid(w.replace("{content}", "x")))


def rendered_note() -> Column:
    """The wording of template_id that `variant` chooses; a finite clause in the modal perfect has wordings of its own."""
    pick = lambda xs: F.get(xs, F.pmod(F.col("variant"), F.size(xs)).cast("int"))
    wordings = F.try_element_at(F.create_map(*[x for t, vs in TEMPLATE_VARIANTS.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in vs]))]), F.col("template_id"))
    modal = (F.col("template_id") == "SENTENCE_FINITE_CLAUSE") & (F.col("tam2") == "modal_perfect")
    return F.replace(F.when(modal, pick(F.array(*[F.lit(v) for v in MODAL_PERFECT_VARIANTS]))).otherwise(pick(wordings)), F.lit("{content}"), F.col("content"))


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with what notes read: tense where the class carries one, first token, the first two longer words."""
    return describe(V.nodes(spark, sf))


def describe(nodes: DataFrame) -> DataFrame:
    d = notes.describe(nodes)
    longer = F.filter(F.regexp_extract_all("content", F.lit("[a-z]+"), 0), lambda x: F.length(x) >= 4)
    return d.withColumn("tense", F.expr(TENSE)).withColumn("lead", F.get("toks", F.lit(0))).withColumn("_longer", longer).withColumn("long1", F.get("_longer", F.lit(0))).withColumn("long2", F.get("_longer", F.lit(1))).drop("_longer")


#: Tense where the class of a node carries one; others are null whatever the node says.
TENSE = "CASE WHEN type = 'Word' AND part_of_speech NOT IN ('verb', 'auxiliary verb') THEN NULL WHEN type = 'Phrase' AND part_of_speech IN ('noun phrase', 'prepositional phrase') THEN NULL WHEN tam = 'past_perfect' THEN 'past' WHEN type = 'Word' AND array_contains(tag, 'VBN') THEN 'past participle' WHEN type = 'Word' AND array_contains(tag, 'VBG') THEN 'present participle' END"


def fallback_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The rule-made note of every node."""
    return described(spark, sf).select("seq", "preorder", F.sha2(fallback_note(), 256).alias("note_sha256"))


def note_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that are valid, by kind.  Rule-made notes repeat: equal ones are counted before they are judged."""
    s = V.sentences(spark, sf).select("text").union(V.read(spark, sf, "benchmark").select("text")).withColumn("n", F.lit(1).cast("long"))
    made = described(spark, sf).groupBy(fallback_note().alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return notes.with_validity(s.union(made), "text").groupBy("valid", "kind").agg(F.sum("n").alias("n"))


def note_novelty_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Per sentence: valid fallback notes that are accepted (the first of its text; those of words always) and those that repeat.

    Sentences are dealt out as texts, so notes are not shuffled.  Words that are sure of a valid note are counted without it.
    """
    d = V.apart(describe(V.nodes(spark, sf, dealt=True)), fallback_wording().alias("wording"))
    word = F.col("type") == "Word"
    sure = word & F.col("wording").isin(*sound_wordings()) & ~T.any_match("content", notes.BAD_INSIDE)
    n = d.select("seq", word.alias("word"), F.when(~sure, filled(F.col("wording"))).alias("note"))
    texts = notes.with_validity(n.groupBy("seq", "word", "note").agg(F.count(F.lit(1)).alias("n")), "note").withColumn("valid", F.col("note").isNull() | F.col("valid"))
    accepted = F.when(F.col("valid"), F.when(F.col("word"), F.col("n")).otherwise(1)).otherwise(0)
    repeated = F.when(F.col("valid") & ~F.col("word"), F.col("n") - 1).otherwise(0)
    return texts.groupBy("seq").agg(F.sum(accepted).cast("long").alias("accepted"), F.sum(repeated).cast("long").alias("repeated"))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with the trace of their selection (level, template_id, matched_key, context_key_matched, matched_level_reason, selection_mode, semantic_rejects) and the rendered note."""
    return select_templates(described(spark, sf))


def select_templates(described: DataFrame) -> DataFrame:
    n = notes.candidates(described)
    level, bar = F.lower("type"), F.lit("|")
    k1, k2 = F.concat(level, bar, "part_of_speech", bar, "dep_label", bar, "tam2", bar, "lex"), F.concat(level, bar, "part_of_speech", bar, "dep_label", bar, "lex")
    k3 = F.concat(level, bar, "part_of_speech")
    tries = F.array(*[F.struct(F.lit(name).alias("level"), F.col(f"t{i}").alias("id"), key.alias("key"), F.coalesce(notes.compatible(F.col(f"t{i}")), F.lit(False)).alias("ok")) for i, (name, key) in enumerate(zip(notes.LEVEL_NAMES, (k1, k2, k3, level)), 1)])
    n = n.withColumn("tries", F.filter(tries, lambda x: x["id"].isNotNull()))
    n = n.withColumn("pick", F.get(F.filter("tries", lambda x: x["ok"]), F.lit(0)))
    known = F.col("pick").isNotNull()
    n = n.withColumn("level", F.when(known, F.col("pick.level")).otherwise(notes.LEVEL_NAMES[3])).withColumn("template_id", F.col("pick.id")).withColumn("matched_key", F.when(known, F.col("pick.key")).otherwise(level))
    n = n.withColumn("rejects", F.when(known, F.size(F.filter("tries", lambda x: ~x["ok"]))).otherwise(F.size("tries")))
    n = n.withColumn("reason", F.when((F.col("level") == notes.LEVEL_NAMES[1]) & F.col("part_of_speech").isin(*TAM_CLASSES), "tam_dropped"))
    mode = F.when(F.col("level") == notes.LEVEL_NAMES[0], "rule_l1_exact").when(F.col("level") == notes.LEVEL_NAMES[1], "rule_l2_drop_tam").when(F.col("level") == notes.LEVEL_NAMES[2], "rule_l3_backoff").otherwise("rule_fallback")
    n = n.withColumn("selection_mode", mode).withColumn("variant", F.conv(F.substring(F.sha2(F.expr(_HASHED), 256), 1, 8), 16, 10).cast("long"))
    return n.withColumn("note", rendered_note()).drop("tries", "pick", "t1", "t2", "t3", "t4")


def template_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The trace and rendered note of every node, counted."""
    s = selected(spark, sf)
    return s.groupBy("type", "level", "template_id", "reason", "selection_mode", "rejects").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("note", 256)).alias("least"))


def _suits(df: DataFrame, note: str, name: str) -> DataFrame:
    judged = notes.with_validity(df, note).drop("kind")
    return judged.withColumn(name, F.coalesce(F.col("valid") & F.expr(SUITABLE.format(f"lower({note})")), F.lit(False))).drop("valid")


def _new(df: DataFrame, tried: Column, note: str, name: str, words: bool = False) -> DataFrame:
    """Whether a tried note is the first of its text in the sentence; those of words always count as new.  words: there are no others."""
    if words:
        return df.withColumn(name, tried)
    key = F.when(tried & (F.col("type") != "Word"), F.lower(note))
    first = F.row_number().over(W.Window.partitionBy("seq", key).orderBy("preorder")) == 1
    return df.withColumn(name, tried & ((F.col("type") == "Word") | first))


def annotated(spark: SparkSession, sf: str, mode: str = "template_only") -> DataFrame:
    """Nodes with their accepted note, its source, kind and confidence, quality flags and reason codes.

    `template_only` tries the rendered template, then the fallback note; `two_stage` only templates, exact ones by the stricter rule.
    """
    return annotate(described(spark, sf), mode)


def annotate(described: DataFrame, mode: str, words: bool = False) -> DataFrame:
    """The same of described nodes; words: there are no others, so they need no sentence.  Only notes whose judgement counts are judged."""
    if mode not in NOTE_MODES:
        raise ValueError(f"unknown note mode {mode}")
    exact = F.col("level").isin(*notes.LEVEL_NAMES[:2])
    s = select_templates(described).withColumn("fallback", fallback_note())
    s = _suits(s.withColumn("_judged", F.col("note") if mode == "template_only" else F.when(exact, F.col("note"))), "_judged", "note_suits")
    s = _new(s, F.col("note_suits") if mode == "template_only" else F.when(exact, F.col("note_suits")).otherwise(F.col("note").isNotNull()), "note", "by_template", words)
    flags = lambda *xs: F.array(*[F.lit(x) for x in xs])
    backoff = F.col("level") != notes.LEVEL_NAMES[0]
    if mode == "template_only":
        s = _suits(s.withColumn("_judged", F.when(~F.col("by_template"), F.col("fallback"))), "_judged", "fallback_suits")
        s = _new(s, ~F.col("by_template") & F.col("fallback_suits"), "fallback", "by_fallback", words)
        accepted = F.when(F.col("by_template"), F.col("note")).when(F.col("by_fallback"), F.col("fallback"))
        quality = F.when(F.col("by_template"), flags("note_generated", "rule_used", "template_selected")).when(F.col("by_fallback"), flags("note_generated", "rule_used", "template_fallback")).otherwise(flags("no_note"))
        reasons = F.when(F.col("by_template"), flags("RULE_TEMPLATE_NOTE_ACCEPTED")).when(F.col("by_fallback"), flags("RULE_TEMPLATE_MISS", "RULE_TEMPLATE_FALLBACK_ACCEPTED")).otherwise(flags("RULE_TEMPLATE_MISS", "NO_VALID_NOTE"))
    else:
        accepted = F.when(F.col("by_template"), F.col("note"))
        quality = F.when(F.col("by_template"), flags("template_selected", "rule_used")).otherwise(flags("no_note"))
        reasons = F.when(F.col("by_template"), flags("RULE_TEMPLATE_ACCEPTED")).otherwise(flags("NO_TEMPLATE_FOUND"))
    # Every node whose level is not exact carries the flag, note or not.
    quality = F.when(backoff, F.array_union(quality, flags("backoff_used"))).otherwise(quality)
    kind = F.expr(KIND.format("lower(accepted)", "CASE WHEN by_template THEN template_id ELSE '' END", rx="rlike"))
    return s.withColumn("accepted", accepted).withColumn("quality_flags", quality).withColumn("reason_codes", reasons).withColumn("kind", F.when(F.col("accepted").isNotNull(), kind)).withColumn("confidence", F.when(F.col("accepted").isNotNull(), F.lit(0.65)))


_READ = ("type", "part_of_speech", "toks", "tag", "tam2", "lex", "level", "template_id", "reason", "rejects", "accepted", "kind", "confidence", "quality_flags", "reason_codes", "n")


def annotated_numbers(spark: SparkSession, sf: str, mode: str, **made: Column) -> DataFrame:
    """Annotated nodes with how many (n) a row stands for: words that are equal (by columns made of seq) are one row, as their notes do not depend on the sentence; of the rest only texts are shuffled."""
    rest = V.nodes(spark, sf, dealt=True).where("type <> 'Word'").withColumns(made)
    rest = annotate(describe(rest), mode).withColumn("n", F.lit(1).cast("long"))
    words = annotate(describe(V.distinct_words(spark, sf, **made)), mode, words=True)
    return rest.select(*made, *_READ).unionByName(words.select(*made, *_READ))


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("type", "level", "kind", "confidence", F.array_join("quality_flags", ",").alias("quality_flags"), F.array_join("reason_codes", ",").alias("reason_codes")).agg(F.sum("n").alias("n"), F.min(F.sha2("accepted", 256)).alias("least"))


def annotate_template_only(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(annotated_numbers(spark, sf, "template_only"))


def annotate_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(annotated_numbers(spark, sf, "two_stage"))


def backoff_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per sentence: counters and lists of the nodes that backed off (ids, distinct reasons, distinct spans), and whether one lies below the sentence."""
    # No filter on the level: it would be pushed below the selection and work it out twice.
    a = selected(spark, sf).select("seq", "preorder", "type", "n_words", "reason", (F.col("level") != notes.LEVEL_NAMES[0]).alias("back"))
    a = a.withColumn("node_id", F.when(F.col("back"), F.concat(F.lit("n"), (F.col("preorder") + 1).cast("string"))))
    inner = F.col("back") & (F.col("type") != "Sentence")
    # Spans are numbered by words: phrases have PHRASE_TOKENS of them.
    at = F.floor((F.col("preorder") - 1) / (V.PHRASE_TOKENS + 1)) * V.PHRASE_TOKENS
    start = F.when(F.col("type") == "Phrase", at).otherwise(at + F.pmod(F.col("preorder") - 1, F.lit(V.PHRASE_TOKENS + 1)) - 1)
    span = F.when(inner, F.concat(start.cast("string"), F.lit(":"), (start + F.col("n_words")).cast("string")))
    g = a.groupBy("seq").agg(
        F.array_sort(F.collect_list("node_id")).alias("ids"), F.count_if(inner).alias("backoff_leaf_nodes_count"), F.count_if("back").alias("backoff_nodes_count"),
        F.array_sort(F.collect_set(F.when(F.col("back"), F.coalesce("reason", F.lit("level_backoff"))))).alias("reasons"), F.array_sort(F.collect_set(span)).alias("spans"),
    ).where("backoff_nodes_count > 0")
    return g.select("seq", "backoff_nodes_count", "backoff_leaf_nodes_count", (F.col("backoff_nodes_count") - F.col("backoff_leaf_nodes_count")).alias("backoff_aggregate_nodes_count"), F.size("spans").alias("backoff_unique_spans_count"), F.array_join("reasons", ",").alias("reasons"), F.sha2(F.array_join("ids", ","), 256).alias("nodes_sha256"), F.sha2(F.array_join("spans", ","), 256).alias("spans_sha256"), (F.col("backoff_leaf_nodes_count") > 0).alias("backoff_in_subtree"))


def template_id_in(text: Column) -> Column:
    """The template id that a model's answer names: before a bar, as a whole, or the first known one among its capital runs."""
    whole = F.upper(T.squeeze(text))
    first = F.trim(F.split_part(whole, F.lit("|"), F.lit(1)))
    known = lambda x: x.isin(*TEMPLATE_VARIANTS)
    runs = F.filter(F.regexp_extract_all(whole, F.lit("[A-Z_]{4,}"), 0), known)
    return F.when(known(first), first).when(known(whole), whole).otherwise(F.coalesce(F.get(runs, F.lit(0)), F.lit("")))


_ANSWER = "CASE seq % 5 WHEN 0 THEN ' vp_auxiliary | note ' WHEN 1 THEN 'NP_POSSESSIVE' WHEN 2 THEN 'I think WORD_NOUN or WORD_ADVERB, maybe' WHEN 3 THEN text ELSE '' END"


def model_template_ids(spark: SparkSession, sf: str) -> DataFrame:
    answers = V.sentences(spark, sf).select(F.expr(_ANSWER).alias("answer"))
    return answers.groupBy(template_id_in(F.col("answer")).alias("template_id")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (fallback_notes, note_validity, note_novelty_fold, template_notes, annotate_template_only, annotate_two_stage, backoff_report, model_template_ids)}

_SQL = lambda e: e.replace("CAST(n_words AS STRING)", "CAST(n_words AS VARCHAR)").replace("rlike(", "regexp_matches(")
FULL = notes.DESCRIBED + f""", full0 AS (SELECT *, {TENSE} AS tense, toks[1] AS lead, list_filter(regexp_extract_all(content, '[a-z]+'), lambda x: length(x) >= 4) AS longer FROM described), full1 AS MATERIALIZED (SELECT *, longer[1] AS long1, longer[2] AS long2 FROM full0)"""
_PICKED = FULL + ", " + ", ".join(notes._VALUES(n, m) for n, m in (("r1", notes.REGISTRY_L1), ("r2", notes.REGISTRY_L2), ("r3", notes.REGISTRY_L3), ("r4", notes.REGISTRY_L4))) + f""",
keyed AS (SELECT *, lower(type) AS k4, lower(type) || '|' || part_of_speech AS k3, lower(type) || '|' || part_of_speech || '|' || dep_label || '|' || lex AS k2, lower(type) || '|' || part_of_speech || '|' || dep_label || '|' || tam2 || '|' || lex AS k1 FROM full1),
tried AS (SELECT keyed.*, 1 AS k, r1.id, k1 AS mk FROM keyed JOIN r1 ON r1.k = k1 UNION ALL SELECT keyed.*, 2, r2.id, k2 FROM keyed JOIN r2 ON r2.k = k2 UNION ALL SELECT keyed.*, 3, r3.id, k3 FROM keyed JOIN r3 ON r3.k = k3 UNION ALL SELECT keyed.*, 4, r4.id, k4 FROM keyed JOIN r4 ON r4.k = k4),
okd AS (SELECT seq, preorder, k, id, mk, {notes._OK} AS ok FROM tried),
sel0 AS (SELECT seq, preorder, min(k) FILTER (ok) AS k, arg_min(id, k) FILTER (ok) AS template_id, arg_min(mk, k) FILTER (ok) AS mk, CAST(count(*) FILTER (NOT ok) AS INTEGER) AS rejects FROM okd GROUP BY 1, 2),
sel1 AS (SELECT f.*, ['L1_EXACT', 'L2_DROP_TAM', 'L3_LEVEL_POS', 'L4_FALLBACK'][coalesce(k, 4)] AS level, template_id, coalesce(mk, lower(type)) AS matched_key, rejects, CASE WHEN k = 2 AND part_of_speech IN ({V.sql_list(TAM_CLASSES)}) THEN 'tam_dropped' END AS reason,
  ['rule_l1_exact', 'rule_l2_drop_tam', 'rule_l3_backoff', 'rule_fallback'][coalesce(k, 4)] AS selection_mode FROM full1 f JOIN sel0 s ON f.seq = s.seq AND f.preorder = s.preorder),
sel2 AS (SELECT *, ('0x' || substr(sha256({_HASHED}), 1, 8))::BIGINT AS variant FROM sel1), sel AS MATERIALIZED (SELECT *, {_SQL(RENDERED)} AS note, {_SQL(FALLBACK)} AS fallback FROM sel2)"""
_VALID_NOTE = lambda c: "(" + notes._VALID.replace("len(ws)", f"len(regexp_extract_all(lower({c}), '[a-z'']+'))").replace("list_filter(ws,", f"list_filter(regexp_extract_all(lower({c}), '[a-z'']+'),").replace("(t ", f"({c} ").replace("(t,", f"({c},").replace("length(t)", f"length({c})") + ")"
_JUDGE = lambda c, name: f"coalesce({_VALID_NOTE(c)} AND {SUITABLE.format(f'lower({c})')}, false) AS {name}"


def _sql_annotated(mode: str) -> str:
    tried = "note_suits" if mode == "template_only" else "CASE WHEN level IN ('L1_EXACT', 'L2_DROP_TAM') THEN note_suits ELSE note IS NOT NULL END"
    first = lambda src, tried, note, name: f"(SELECT *, {tried} AND (type = 'Word' OR row_number() OVER (PARTITION BY seq, CASE WHEN {tried} AND type <> 'Word' THEN lower({note}) END ORDER BY preorder) = 1) AS {name} FROM {src})"
    head = _PICKED + f", a0 AS (SELECT *, {_JUDGE('note', 'note_suits')}, {_JUDGE('fallback', 'fallback_suits')} FROM sel), a1 AS {first('a0', f'({tried})', 'note', 'by_template')}, a2 AS {first('a1', '(NOT by_template AND fallback_suits)', 'fallback', 'by_fallback')}"
    if mode == "template_only":
        accepted = "CASE WHEN by_template THEN note WHEN by_fallback THEN fallback END"
        flags = "CASE WHEN by_template THEN 'note_generated,rule_used,template_selected' WHEN by_fallback THEN 'note_generated,rule_used,template_fallback' ELSE 'no_note' END"
        reasons = "CASE WHEN by_template THEN 'RULE_TEMPLATE_NOTE_ACCEPTED' WHEN by_fallback THEN 'RULE_TEMPLATE_MISS,RULE_TEMPLATE_FALLBACK_ACCEPTED' ELSE 'RULE_TEMPLATE_MISS,NO_VALID_NOTE' END"
    else:
        accepted, flags, reasons = "CASE WHEN by_template THEN note END", "CASE WHEN by_template THEN 'template_selected,rule_used' ELSE 'no_note' END", "CASE WHEN by_template THEN 'RULE_TEMPLATE_ACCEPTED' ELSE 'NO_TEMPLATE_FOUND' END"
    kind = KIND.format("lower(accepted)", "CASE WHEN by_template THEN template_id ELSE '' END", rx="regexp_matches")
    head += f", a3 AS (SELECT *, {accepted} AS accepted, {flags} || CASE WHEN level <> 'L1_EXACT' THEN ',backoff_used' ELSE '' END AS quality_flags, {reasons} AS reason_codes FROM a2), a4 AS (SELECT *, CASE WHEN accepted IS NOT NULL THEN {kind} END AS kind, CASE WHEN accepted IS NOT NULL THEN 0.65::DOUBLE END AS confidence FROM a3)"
    return V.sql(head, "SELECT type, level, kind, confidence, quality_flags, reason_codes, count(*) AS n, min(sha256(accepted)) AS least FROM a4 GROUP BY ALL")


_IDS = V.sql_list(tuple(TEMPLATE_VARIANTS))
ORACLES = {
    "fallback_notes": V.sql(FULL, f"SELECT seq, CAST(preorder AS INTEGER) AS preorder, sha256({_SQL(FALLBACK)}) AS note_sha256 FROM full1"),
    "note_validity": V.sql(FULL, rf""", texts AS (SELECT text FROM sentences UNION ALL SELECT text FROM benchmark UNION ALL SELECT {_SQL(FALLBACK)} FROM full1), s AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM texts), w AS (SELECT t, regexp_extract_all(lower(t), '[a-z'']+') AS ws FROM s)
      SELECT {notes._VALID} AS valid, CASE WHEN regexp_matches(lower(t), 'tense|aspect|voice|mood|verb form|plural|singular') THEN 'morphological' WHEN regexp_matches(lower(t), 'subject|predicate|object|clause|phrase|sentence|agreement') THEN 'syntactic'
        WHEN regexp_matches(lower(t), 'topic|context|cohesion|register|emphasis') THEN 'discourse' ELSE 'semantic' END AS kind, count(*) AS n FROM w GROUP BY 1, 2"""),
    "note_novelty_fold": V.sql(FULL, rf""", v AS (SELECT seq, preorder, type, {_SQL(FALLBACK)} AS t FROM full1), x AS (SELECT *, regexp_extract_all(lower(t), '[a-z'']+') AS ws FROM v),
      y AS (SELECT seq, type, {notes._VALID} AS ok, row_number() OVER (PARTITION BY seq, type = 'Word', t ORDER BY preorder) AS r FROM x)
      SELECT seq, count(*) FILTER (ok AND (type = 'Word' OR r = 1)) AS accepted, count(*) FILTER (ok AND type <> 'Word' AND r > 1) AS repeated FROM y GROUP BY seq"""),
    "template_notes": V.sql(_PICKED, "SELECT type, level, template_id, reason, selection_mode, rejects, count(*) AS n, min(sha256(note)) AS least FROM sel GROUP BY ALL"),
    "annotate_template_only": _sql_annotated("template_only"),
    "annotate_two_stage": _sql_annotated("two_stage"),
    "backoff_report": V.sql(_PICKED, f""", b0 AS (SELECT *, (preorder - 1) // {V.PHRASE_TOKENS + 1} * {V.PHRASE_TOKENS} AS base FROM sel WHERE level <> 'L1_EXACT'), b1 AS (SELECT *, CASE type WHEN 'Phrase' THEN base ELSE base + (preorder - 1) % {V.PHRASE_TOKENS + 1} - 1 END AS st FROM b0),
      b2 AS (SELECT seq, count(*) AS backoff_nodes_count, count(*) FILTER (type <> 'Sentence') AS backoff_leaf_nodes_count, list_sort(list(DISTINCT coalesce(reason, 'level_backoff'))) AS rs, list_sort(list('n' || (preorder + 1))) AS ids, list_sort(list(DISTINCT CAST(st AS BIGINT) || ':' || CAST(st + n_words AS BIGINT)) FILTER (type <> 'Sentence')) AS sp FROM b1 GROUP BY seq)
      SELECT seq, backoff_nodes_count, backoff_leaf_nodes_count, backoff_nodes_count - backoff_leaf_nodes_count AS backoff_aggregate_nodes_count, CAST(coalesce(len(sp), 0) AS INTEGER) AS backoff_unique_spans_count, array_to_string(rs, ',') AS reasons, sha256(array_to_string(ids, ',')) AS nodes_sha256, sha256(coalesce(array_to_string(sp, ','), '')) AS spans_sha256, backoff_leaf_nodes_count > 0 AS backoff_in_subtree FROM b2"""),
    "model_template_ids": V.sql(V.SENTENCES, rf""", w AS (SELECT upper(trim(regexp_replace({_ANSWER}, '\s+', ' ', 'g'))) AS w FROM sentences), x AS (SELECT w, trim(split_part(w, '|', 1)) AS f, list_filter(regexp_extract_all(w, '[A-Z_]{{4,}}'), lambda t: t IN ({_IDS})) AS runs FROM w)
      SELECT CASE WHEN f IN ({_IDS}) THEN f WHEN w IN ({_IDS}) THEN w ELSE coalesce(runs[1], '') END AS template_id, count(*) AS n FROM x GROUP BY 1"""),
}
