"""Enrichment: providers asked once for each distinct text, a cache with lifetimes, synonyms, level features and prompts; quality of the enrichment fields of contracts.

Every provider has a deterministic default that runs in the JVM; `functions.providers.enrich` takes another one.
Expressions that Spark and the checking SQL share read columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..plans import views as V
from . import contract as C
from .grammar import IRREGULAR
from .notes import DESCRIBED, described
from .store import CEFR_LEVELS

#: Locales of languages.
LOCALES = {"en": "en-US", "ru": "ru-RU", "uk": "uk-UA", "de": "de-DE", "fr": "fr-FR", "es": "es-ES", "it": "it-IT", "pt": "pt-PT", "pl": "pl-PL", "tr": "tr-TR"}
#: Classes that have synonyms; particles of verbs.
LEXICAL = ("noun", "verb", "adjective", "adverb")
PARTICLES = {"bank": "on", "rely": "on", "count": "on", "depend": "on"}
SOURCE, TARGET, MODEL = "en", "ru", "echo"
TOP_K = 2


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


# --- quality of contracts' fields

_TRANSLATED = "k_translation = 'object' AND k_translation__text = 'string' AND trim(t_translation__text) <> ''"
_LANGS = f"coalesce(t_translation__source_lang, '') = '{SOURCE}' AND coalesce(t_translation__target_lang, '') = '{TARGET}'"
#: Whether the value of a field is valid.
VALID = {
    "translation": f"coalesce({_TRANSLATED} AND k_translation__source_lang = 'string' AND trim(t_translation__source_lang) <> '' AND k_translation__target_lang = 'string' AND trim(t_translation__target_lang) <> '', false)",
    "phonetic": "coalesce(k_phonetic = 'object' AND k_phonetic__uk = 'string' AND trim(t_phonetic__uk) <> '' AND k_phonetic__us = 'string' AND trim(t_phonetic__us) <> '', false)",
    "synonyms": f"coalesce(k_synonyms = 'list' AND synonyms_fine AND NOT (trim(t_type) = 'Word' AND lower(trim(t_part_of_speech)) IN ({V.sql_list(LEXICAL)}) AND n_synonyms = 0), false)",
    "cefr_level": f"coalesce(k_cefr_level = 'string' AND upper(trim(t_cefr_level)) IN ({V.sql_list(CEFR_LEVELS)}), false)",
}
_INNER = "coalesce(trim(t_type), '') <> 'Sentence'"


def fields(contracts: DataFrame) -> DataFrame:
    """Object nodes of contracts with the columns that the field rules read."""
    n = C.described(C.contract_nodes(contracts)).where("k_node = 'object'")
    xs = F.try_variant_get("node", "$.synonyms", "array<variant>")
    strings = F.transform(xs, lambda x: F.when(C.kind(x) == "string", F.lower(F.trim(F.try_variant_get(x, "$", "string")))))
    fine = F.forall(strings, lambda x: x.isNotNull() & (x != "")) & (F.size(F.array_distinct(strings)) == F.size(strings))
    return n.withColumn("synonyms_fine", F.coalesce(fine, F.lit(False)))


def enrichment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Of each enrichment field the nodes below sentences where it is valid, missing, invalid, and the valid ones' share."""
    n = fields(C.contracts(spark, sf)).where(_INNER)
    states = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(f"CASE WHEN k_{f} IS NULL THEN 'missing' WHEN {ok} THEN 'valid' ELSE 'invalid' END").alias("state")) for f, ok in VALID.items()])
    g = n.select(F.inline(states)).groupBy("field").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("valid", "missing", "invalid")], F.count(F.lit(1)).alias("total"))
    return g.select("field", "valid", "missing", "invalid", F.round(F.col("valid") / F.col("total"), 6).alias("coverage"))


def enrichment_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Of each contract whether its sentence's fields are valid."""
    n = fields(C.contracts(spark, sf)).where("depth = 0")
    return n.select("doc_id", "path", *[F.expr(ok).alias(f"{f}_ok") for f, ok in VALID.items()])


def _phonetic_probe(n: DataFrame) -> DataFrame:
    inner, ok = F.expr(_INNER), F.expr(VALID["phonetic"])
    missing = F.coalesce(F.col("k_phonetic") == "null", F.lit(True))
    return n.groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(inner).alias("non_sentence_nodes"), F.count_if(inner & ok).alias("valid_node_phonetics"), F.count_if(inner & missing).alias("missing_phonetic_nodes"), F.count_if(inner & ~missing & ~ok).alias("invalid_phonetic_nodes"),
        F.bool_or((F.col("depth") == 0) & ok).alias("sentence_phonetic_ok"),
    )


def phonetic_qc_probe(spark: SparkSession, sf: str) -> DataFrame:
    p = _phonetic_probe(fields(C.contracts(spark, sf)))
    return p.withColumn("node_phonetic_coverage", F.coalesce(F.round(F.try_divide("valid_node_phonetics", "non_sentence_nodes"), 6), F.lit(0.0)))


def _shares(sums: DataFrame, **shares: tuple[str, str]) -> DataFrame:
    return sums.select("*", *[F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 6), F.lit(0.0)).alias(name) for name, (a, b) in shares.items()])


_PHONETIC = ("nodes", "non_sentence_nodes", "valid_node_phonetics", "missing_phonetic_nodes", "invalid_phonetic_nodes")
_TRANSLATION = ("nodes", "non_sentence_nodes", "translated_nodes", "missing_translation_nodes", "empty_translation_nodes", "lang_mismatch_nodes")


def phonetic_qc_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    p = _phonetic_probe(fields(C.contracts(spark, sf)))
    s = p.agg(F.count(F.lit(1)).alias("probe_count"), *[F.sum(c).alias(c) for c in _PHONETIC], F.count_if("sentence_phonetic_ok").alias("sentence_phonetic_ok_count"))
    return _shares(s, node_phonetic_coverage=("valid_node_phonetics", "non_sentence_nodes"), sentence_phonetic_ok_rate=("sentence_phonetic_ok_count", "probe_count"))


def _translation_probe(n: DataFrame) -> DataFrame:
    inner, done, langs = F.expr(_INNER), F.coalesce(F.expr(_TRANSLATED), F.lit(False)), F.expr(_LANGS)
    missing = F.coalesce(F.col("k_translation") != "object", F.lit(True))
    return n.groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(inner).alias("non_sentence_nodes"), F.count_if(inner & done).alias("translated_nodes"), F.count_if(inner & missing).alias("missing_translation_nodes"), F.count_if(inner & ~missing & ~done).alias("empty_translation_nodes"),
        F.count_if(inner & done & ~langs).alias("lang_mismatch_nodes"), F.bool_or((F.col("depth") == 0) & done & langs).alias("sentence_translation_ok"),
    )


def translation_qc_probe(spark: SparkSession, sf: str) -> DataFrame:
    p = _translation_probe(fields(C.contracts(spark, sf)))
    return p.withColumn("node_translation_coverage", F.coalesce(F.round(F.try_divide("translated_nodes", "non_sentence_nodes"), 6), F.lit(0.0)))


def translation_qc_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    p = _translation_probe(fields(C.contracts(spark, sf)))
    s = p.agg(F.count(F.lit(1)).alias("probe_count"), *[F.sum(c).alias(c) for c in _TRANSLATION], F.count_if("sentence_translation_ok").alias("sentence_translation_ok_count"))
    s = s.withColumn("issues", F.col("missing_translation_nodes") + F.col("empty_translation_nodes") + F.col("lang_mismatch_nodes"))
    return _shares(s, node_translation_coverage=("translated_nodes", "non_sentence_nodes"), sentence_translation_ok_rate=("sentence_translation_ok_count", "probe_count"), translation_issue_rate=("issues", "non_sentence_nodes")).drop("issues")


#: What a viewer shows where a field is missing.
_FILLED = {
    "cefr_level": "coalesce(t_cefr_level, CASE WHEN k_cefr_level IS NULL THEN 'B1' END)", "source_lang": f"CASE WHEN k_translation = 'object' THEN CASE WHEN k_translation__source_lang IS NULL THEN '{SOURCE}' ELSE t_translation__source_lang END ELSE '{SOURCE}' END",
    "target_lang": f"CASE WHEN k_translation = 'object' THEN CASE WHEN k_translation__target_lang IS NULL THEN '{TARGET}' ELSE t_translation__target_lang END ELSE '{TARGET}' END",
    "text": "CASE WHEN k_translation = 'object' AND k_translation__text IS NOT NULL THEN t_translation__text ELSE coalesce(t_content, '') END",
    "uk": "CASE WHEN k_phonetic = 'object' AND k_phonetic__uk IS NOT NULL THEN t_phonetic__uk ELSE '' END", "us": "CASE WHEN k_phonetic = 'object' AND k_phonetic__us IS NOT NULL THEN t_phonetic__us ELSE '' END",
}


def visualizer_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes as a viewer gets them: defaults for level, translation and phonetics."""
    n = C.described(C.contract_nodes(C.contracts(spark, sf))).where("k_node = 'object'")
    return n.select("doc_id", "path", *[F.expr(e).alias(c) for c, e in _FILLED.items()])


# --- providers

def echo_translation(text: Column) -> Column:
    """The default translator: the text itself."""
    return F.trim(text)


def letters_as_phonemes(text: Column) -> Column:
    """The default transcriber: letters, normalised as any transcription is: underscores are spaces, white space is single."""
    return T.squeeze(F.replace(F.lower(text), F.lit("_"), F.lit(" ")))


def ask_once(df: DataFrame, key: str, answer) -> DataFrame:
    """df with `answer` (a function of a column) for its key, asked over distinct keys and joined back; null keys have no answer."""
    asked = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(asked.select(key, answer(F.col(key)).alias("answer")), key, "left")


_SPAN = "preorder % 5 AS start, preorder % 5 + length(content) * (CASE WHEN preorder % 11 = 0 THEN 1000 ELSE 1 END) AS stop"
_SOURCE_TEXT = "CASE WHEN 0 <= start AND start <= stop AND stop <= length(sentence) THEN substring(sentence, start + 1, stop - start) ELSE coalesce(content, '') END"


def node_source_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of nodes by their span in the sentence, or their content where the span does not fit."""
    n = V.nodes(spark, sf).selectExpr("type", "content", "sentence", *_SPAN.split(", ", 1))
    s = n.withColumn("source_text", F.expr(_SOURCE_TEXT))
    return s.groupBy("type", (F.col("source_text") == F.col("content")).alias("content_itself")).agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("source_text", 256)).alias("least"))


def enrich_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Translation and transcription of every node, providers asked once for each distinct text: nodes, distinct texts, least digest by type."""
    n = V.nodes(spark, sf).select("seq", "type", "content")
    t = ask_once(n, "content", echo_translation).withColumnRenamed("answer", "translation")
    p = ask_once(t, "content", letters_as_phonemes).withColumnRenamed("answer", "phonetic")
    joined = F.sha2(F.concat("translation", F.lit("|"), F.lit(SOURCE), F.lit("|"), F.lit(TARGET), F.lit("|"), "phonetic"), 256)
    return p.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("content").alias("texts"), F.min(joined).alias("least"))


def cache_key(text: Column, source: str = SOURCE, target: str = TARGET, model: str = MODEL, prefix: str = "tr:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(f"{model}|{source}|{target}|"), text), 256))


def from_cache(requests: DataFrame, cache: DataFrame, now: int, answer) -> DataFrame:
    """requests(text) with value and state: `hit` where cache(key, value, set_at, ttl) holds a live entry (ttl 0: for ever), else `expired` or `miss`, answered by the provider.

    The latest entry of a key counts.
    """
    latest = cache.groupBy("key").agg(F.max_by(F.struct("value", "set_at", "ttl"), "set_at").alias("e"))
    j = requests.select("text").distinct().withColumn("key", cache_key(F.col("text"))).join(latest, "key", "left")
    live = (F.col("e.ttl") == 0) | (F.col("e.set_at") + F.col("e.ttl") > now)
    state = F.when(F.col("e").isNull(), "miss").when(live, "hit").otherwise("expired")
    return j.select("text", "key", state.alias("state"), F.when(state == "hit", F.col("e.value")).otherwise(answer(F.col("text"))).alias("value"))


NOW = 1_000
_CACHE = {"value": "'v:' || substring(sha, 1, 8)", "set_at": "k * 13 % 900", "ttl": "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 700 END"}


def translation_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for sentences against a cache of two thirds of them: hits, expired entries, misses, by their number and values."""
    s = V.sentences(spark, sf).select(F.col("text"), (F.col("seq") % 1000).alias("k"), F.sha2("text", 256).alias("sha"))
    cache = s.where("k % 3 <> 2").select(cache_key(F.col("text")).alias("key"), *[F.expr(e).alias(c) for c, e in _CACHE.items()])
    # One entry a key: of copies the one set last, then the greatest value and lifetime.
    cache = cache.groupBy("key").agg(F.max(F.struct("set_at", "value", "ttl")).alias("e")).select("key", "e.*")
    got = from_cache(s, cache, NOW, echo_translation)
    return got.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(F.concat("key", F.lit("|"), "value"), 256)).alias("least"))


def locale_of(lang: Column) -> Column:
    low = F.lower(F.trim(lang))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in LOCALES.items() for x in kv]), low)
    return F.when(F.coalesce(low, F.lit("")) == "", "en-US").otherwise(F.coalesce(known, F.concat(low, F.lit("-"), F.upper(low))))


def translation_locales(spark: SparkSession, sf: str) -> DataFrame:
    d = V.read(spark, sf, "documents").select(F.expr("CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' || lang WHEN 2 THEN 'nl' WHEN 3 THEN '' ELSE lang END").alias("lang"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", locale_of(F.col("lang")).alias("locale"), "n")


def lexicon_synonyms(df: DataFrame, lexicon: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """df(text, pos) with `synonyms`: the first lemmas of lexicon(word, pos, k, lemma) by k that differ from the text and one another; only lexical classes have any.

    The lexicon is aggregated to one row for each word and class before the join.
    """
    clean = F.lower(T.squeeze(F.replace("lemma", F.lit("_"), F.lit(" "))))
    named = lexicon.select("word", "pos", "k", clean.alias("lemma")).where((F.col("lemma") != "") & (F.col("lemma") != F.lower(T.squeeze("word"))))
    first = named.groupBy("word", "pos", "lemma").agg(F.min("k").alias("k"))
    ranked = first.withColumn("r", F.row_number().over(W.Window.partitionBy("word", "pos").orderBy("k"))).where(F.col("r") <= top_k)
    lists = ranked.groupBy("word", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "lemma"))), lambda x: x["lemma"]).alias("synonyms"))
    return df.withColumn("word", F.when(F.col("pos").isin(*LEXICAL), F.lower(T.squeeze("text")))).join(lists, ["word", "pos"], "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>"))).drop("word")


_LEMMAS = "word || '_x', upper(word), 'to ' || word, word || '_x', word || 's'"


def synonym_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Synonyms of all words from a lexicon, by class: words, words with synonyms, distinct lists and their least."""
    words = described(spark, sf).where("type = 'Word'").select(F.col("content").alias("text"), F.col("part_of_speech").alias("pos"))
    vocabulary = words.select(F.col("text").alias("word"), "pos").distinct()
    lexicon = vocabulary.select("word", "pos", F.posexplode(F.array(*[F.expr(e) for e in _LEMMAS.split(", ")])).alias("k", "lemma"))
    j = lexicon_synonyms(words, lexicon).withColumn("list", F.array_join("synonyms", ","))
    return j.groupBy("pos").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.size("synonyms") > 0).alias("with_synonyms"), F.countDistinct("list").alias("lists"), F.min("list").alias("least"))


#: The past participle of `head`.
_PARTICIPLE = _case("head", IRREGULAR, "CASE WHEN head LIKE '%e' THEN head || 'd' WHEN length(head) > 1 AND head LIKE '%y' AND substring(head, length(head) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substring(head, 1, length(head) - 1) || 'ied' ELSE head || 'ed' END")
_HEAD = "split_part(cand, ' ', 1)"
_PARTICLED = f"CASE WHEN pos = 'verb' AND cand = head AND head IN ({V.sql_list(tuple(PARTICLES))}) THEN head || ' ' || {_case('head', PARTICLES, chr(39) * 2)} ELSE cand END"
_INFLECTED = f"CASE WHEN pos = 'verb' AND participle THEN {_PARTICIPLE} || substring(particled, length(head) + 1) ELSE particled END"
_VERBS = (*IRREGULAR, *PARTICLES, "carry on", "play", "move", "try", "Bank ", "  ", "walk away")


def synonym_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas fitted to their node: verbs get their particle, and the past participle where the node is one."""
    c = V.read(spark, sf, "conversations").select("conv_id", "turn", F.expr("CASE (conv_id + turn) % 3 WHEN 0 THEN 'noun' ELSE 'verb' END").alias("pos"), F.expr("(conv_id + turn) % 3 = 2").alias("participle"))
    lemma = F.get(F.array(*[F.lit(x) for x in _VERBS]), (F.col("conv_id") * 7 + F.col("turn")).cast("int") % len(_VERBS))
    c = c.withColumn("cand", F.lower(T.squeeze(lemma))).where("cand <> ''").withColumn("head", F.expr(_HEAD)).withColumn("particled", F.expr(_PARTICLED))
    return c.select("conv_id", "turn", F.expr(_INFLECTED).alias("synonym"))


# --- levels by a model: features and prompts

_ROLE = "CASE type WHEN 'Sentence' THEN 'clause' ELSE dep_label END"
_MOOD = "CASE WHEN tam2 = 'modal_perfect' THEN 'modal' ELSE 'indicative' END"
_LEVEL_PROMPT = """'task: predict_cefr_level template_version: v1 node_type: ' || type || ' tam_bucket: ' || tam2 || ' sentence: ' || sentence || CASE type WHEN 'Phrase' THEN ' phrase: ' || content WHEN 'Word' THEN ' word: ' || content ELSE '' END
  || ' pos: ' || part_of_speech || CASE type WHEN 'Word' THEN ' tag: UNKNOWN' ELSE '' END || ' dep: ' || dep_label || CASE type WHEN 'Word' THEN ' morph: ' || CASE WHEN first_tag = '' THEN 'UNKNOWN' ELSE 'Tag:' || first_tag END ELSE '' END"""


def level_features(spark: SparkSession, sf: str) -> DataFrame:
    """The nine features that a level model takes, counted by all but the lengths, which are summed."""
    d = described(spark, sf).withColumn("grammatical_role", F.expr(_ROLE)).withColumn("mood", F.expr(_MOOD))
    words = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    d = d.select(
        F.col("type").alias("node_type"), "part_of_speech", "grammatical_role", words("content").alias("word_count"), F.length("content").alias("char_count"), words("sentence").alias("sentence_word_count"),
        (F.col("mood") == "modal").cast("int").alias("is_modal"), (F.col("tam2") == "modal_perfect").cast("int").alias("is_perfect"), (F.coalesce(F.get("tag", F.lit(0)), F.lit("")).isin("VBG", "VBN") & (F.col("type") == "Word")).cast("int").alias("is_non_finite"),
    )
    return d.groupBy("node_type", "part_of_speech", "grammatical_role", "is_modal", "is_perfect", "is_non_finite").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in ("word_count", "char_count", "sentence_word_count")])


def level_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for a level model, by type and class: how many and the least digest."""
    d = described(spark, sf).withColumn("first_tag", F.coalesce(F.get("tag", F.lit(0)), F.lit("")))
    return d.groupBy("type", "part_of_speech").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(F.expr(_LEVEL_PROMPT), 256)).alias("least"))


QUERIES = {f.__name__: f for f in (
    enrichment_coverage, enrichment_sentences, phonetic_qc_probe, phonetic_qc_aggregate, translation_qc_probe, translation_qc_aggregate, visualizer_fields, node_source_text, enrich_attach, translation_cache, translation_locales, synonym_attach, synonym_postprocess,
    level_features, level_prompts,
)}

_STRINGS = f"list_transform({C._sql_list(C._sql_at('node', 'synonyms'))}, lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN lower(trim(json_extract_string(x, '$'))) END)"
_FIELDS = f"WITH RECURSIVE {C._sql_contracts('c')}, {C._sql_nodes('n', 'c')}, {C._DESCRIBED}, f0 AS (SELECT *, {_STRINGS} AS xs FROM o), f AS MATERIALIZED (SELECT *, len(list_filter(xs, lambda x: x IS NULL OR x = '')) = 0 AND len(list_distinct(xs)) = len(xs) AS synonyms_fine FROM f0)"
_P = f"{_FIELDS}, p AS (SELECT doc_id, key, count(*) AS nodes, count(*) FILTER ({_INNER}) AS non_sentence_nodes, count(*) FILTER ({_INNER} AND {VALID['phonetic']}) AS valid_node_phonetics, count(*) FILTER ({_INNER} AND coalesce(k_phonetic = 'null', true)) AS missing_phonetic_nodes, count(*) FILTER ({_INNER} AND k_phonetic <> 'null' AND NOT {VALID['phonetic']}) AS invalid_phonetic_nodes, bool_or(depth = 0 AND {VALID['phonetic']}) AS sentence_phonetic_ok FROM f GROUP BY 1, 2)"
_DONE = f"coalesce({_TRANSLATED}, false)"
_T = f"{_FIELDS}, p AS (SELECT doc_id, key, count(*) AS nodes, count(*) FILTER ({_INNER}) AS non_sentence_nodes, count(*) FILTER ({_INNER} AND {_DONE}) AS translated_nodes, count(*) FILTER ({_INNER} AND coalesce(k_translation <> 'object', true)) AS missing_translation_nodes, count(*) FILTER ({_INNER} AND k_translation = 'object' AND NOT {_DONE}) AS empty_translation_nodes, count(*) FILTER ({_INNER} AND {_DONE} AND NOT ({_LANGS})) AS lang_mismatch_nodes, bool_or(depth = 0 AND {_DONE} AND {_LANGS}) AS sentence_translation_ok FROM f GROUP BY 1, 2)"
_SUMS = lambda cs: ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in cs)
_SHARE = lambda a, b, n: f"coalesce(round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6), 0.0::DOUBLE) AS {n}"
_N = V.NODES + ", sent AS MATERIALIZED (SELECT seq, content AS sentence FROM nodes WHERE type = 'Sentence')"
_D = DESCRIBED + ", sent AS MATERIALIZED (SELECT seq, content AS sentence FROM nodes WHERE type = 'Sentence')"
_LOCALE = f"CASE WHEN coalesce(lower(trim(lang)), '') = '' THEN 'en-US' ELSE {_case('lower(trim(lang))', LOCALES, chr(39) * 2 + ' || lower(trim(lang)) || ' + chr(39) + '-' + chr(39) + ' || upper(trim(lang))')} END"
_VERB_LIST = "[" + V.sql_list(_VERBS) + "]"
ORACLES = {
    "enrichment_coverage": _FIELDS + ", s AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CASE WHEN k_{f} IS NULL THEN 'missing' WHEN {ok} THEN 'valid' ELSE 'invalid' END AS state FROM f WHERE {_INNER}" for f, ok in VALID.items()) + ") SELECT field, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'invalid') AS invalid, round(count(*) FILTER (state = 'valid') / count(*), 6) AS coverage FROM s GROUP BY field",
    "enrichment_sentences": _FIELDS + " SELECT doc_id, path, " + ", ".join(f"{ok} AS {f}_ok" for f, ok in VALID.items()) + " FROM f WHERE depth = 0",
    "phonetic_qc_probe": f"{_P} SELECT *, {_SHARE('valid_node_phonetics', 'non_sentence_nodes', 'node_phonetic_coverage')} FROM p",
    "phonetic_qc_aggregate": f"{_P}, s AS (SELECT count(*) AS probe_count, {_SUMS(_PHONETIC)}, count(*) FILTER (sentence_phonetic_ok) AS sentence_phonetic_ok_count FROM p) SELECT *, {_SHARE('valid_node_phonetics', 'non_sentence_nodes', 'node_phonetic_coverage')}, {_SHARE('sentence_phonetic_ok_count', 'probe_count', 'sentence_phonetic_ok_rate')} FROM s",
    "translation_qc_probe": f"{_T} SELECT *, {_SHARE('translated_nodes', 'non_sentence_nodes', 'node_translation_coverage')} FROM p",
    "translation_qc_aggregate": f"{_T}, s AS (SELECT count(*) AS probe_count, {_SUMS(_TRANSLATION)}, count(*) FILTER (sentence_translation_ok) AS sentence_translation_ok_count FROM p) SELECT *, {_SHARE('translated_nodes', 'non_sentence_nodes', 'node_translation_coverage')}, {_SHARE('sentence_translation_ok_count', 'probe_count', 'sentence_translation_ok_rate')}, {_SHARE('(missing_translation_nodes + empty_translation_nodes + lang_mismatch_nodes)', 'non_sentence_nodes', 'translation_issue_rate')} FROM s",
    "visualizer_fields": f"WITH RECURSIVE {C._sql_contracts('c')}, {C._sql_nodes('n', 'c')}, {C._DESCRIBED} SELECT doc_id, path, " + ", ".join(f"{e} AS {c}" for c, e in _FILLED.items()) + " FROM o",
    "node_source_text": V.sql(_N, f", x AS (SELECT type, content, sentence, {_SPAN} FROM nodes JOIN sent USING (seq)), y AS (SELECT type, content, {_SOURCE_TEXT} AS source_text FROM x) SELECT type, source_text = content AS content_itself, count(*) AS n, min(sha256(source_text)) AS least FROM y GROUP BY 1, 2"),
    "enrich_attach": V.sql(V.NODES, f"SELECT type, count(*) AS nodes, count(DISTINCT content) AS texts, min(sha256(trim(content) || '|{SOURCE}|{TARGET}|' || trim(replace(lower(content), '_', ' ')))) AS least FROM nodes GROUP BY type"),
    "translation_cache": V.sql(V.SENTENCES, f""", s AS (SELECT text, seq % 1000 AS k, sha256(text) AS sha, 'tr:' || sha256('{MODEL}|{SOURCE}|{TARGET}|' || text) AS key FROM sentences), e AS (SELECT key, {', '.join(f'{e} AS {c}' for c, e in _CACHE.items())} FROM s WHERE k % 3 <> 2),
      l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY set_at DESC, value DESC, ttl DESC) AS r FROM e) WHERE r = 1), j AS (SELECT DISTINCT s.key, s.text, CASE WHEN l.key IS NULL THEN 'miss' WHEN ttl = 0 OR set_at + ttl > {NOW} THEN 'hit' ELSE 'expired' END AS state, l.value FROM s LEFT JOIN l ON s.key = l.key)
      SELECT state, count(*) AS n, min(sha256(key || '|' || CASE state WHEN 'hit' THEN value ELSE trim(text) END)) AS least FROM j GROUP BY state"""),
    "translation_locales": f"WITH d AS (SELECT CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' || lang WHEN 2 THEN 'nl' WHEN 3 THEN '' ELSE lang END AS lang FROM documents) SELECT lang, {_LOCALE} AS locale, count(*) AS n FROM d GROUP BY 1, 2",
    "synonym_attach": V.sql(DESCRIBED, f""", w AS (SELECT content AS word, part_of_speech AS pos FROM described WHERE type = 'Word'), v AS (SELECT DISTINCT word, pos FROM w WHERE pos IN ({V.sql_list(LEXICAL)})), l0 AS (SELECT word, pos, unnest([{_LEMMAS}]) AS lemma, unnest(range(5)) AS k FROM v),
      l1 AS (SELECT word, pos, lower(trim(replace(lemma, '_', ' '))) AS lemma, min(k) AS k FROM l0 GROUP BY 1, 2, 3), l2 AS (SELECT *, row_number() OVER (PARTITION BY word, pos ORDER BY k) AS r FROM l1 WHERE lemma <> '' AND lemma <> word), l3 AS (SELECT word, pos, string_agg(lemma, ',' ORDER BY r) AS list FROM l2 WHERE r <= {TOP_K} GROUP BY 1, 2)
      SELECT w.pos, count(*) AS words, count(list) AS with_synonyms, count(DISTINCT coalesce(list, '')) AS lists, min(coalesce(list, '')) AS least FROM w LEFT JOIN l3 ON w.word = l3.word AND w.pos = l3.pos GROUP BY 1"""),
    "synonym_postprocess": rf"""WITH a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'noun' ELSE 'verb' END AS pos, (conv_id + turn) % 3 = 2 AS participle, lower(trim(regexp_replace({_VERB_LIST}[(conv_id * 7 + turn) % {len(_VERBS)} + 1], '\s+', ' ', 'g'))) AS cand FROM conversations), b AS (SELECT *, {_HEAD} AS head FROM a WHERE cand <> ''), c AS (SELECT *, {_PARTICLED} AS particled FROM b)
      SELECT conv_id, turn, {_INFLECTED} AS synonym FROM c""",
    "level_features": V.sql(_D, f""", x AS (SELECT type AS node_type, part_of_speech, {_ROLE} AS grammatical_role, n_words AS word_count, length(content) AS char_count, len(string_split(sentence, ' ')) AS sentence_word_count, CAST({_MOOD} = 'modal' AS INTEGER) AS is_modal, CAST(tam2 = 'modal_perfect' AS INTEGER) AS is_perfect, CAST(type = 'Word' AND coalesce(tag[1], '') IN ('VBG', 'VBN') AS INTEGER) AS is_non_finite FROM described JOIN sent USING (seq))
      SELECT node_type, part_of_speech, grammatical_role, is_modal, is_perfect, is_non_finite, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS word_count, CAST(sum(char_count) AS BIGINT) AS char_count, CAST(sum(sentence_word_count) AS BIGINT) AS sentence_word_count FROM x GROUP BY ALL"""),
    "level_prompts": V.sql(_D, f", x AS (SELECT *, coalesce(tag[1], '') AS first_tag FROM described JOIN sent USING (seq)) SELECT type, part_of_speech, count(*) AS n, min(sha256({_LEVEL_PROMPT})) AS least FROM x GROUP BY 1, 2"),
}
