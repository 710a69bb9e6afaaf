"""Derived views on the driver's tables, as DataFrames and as DuckDB common table expressions.

The annotation tables of the library (sentences, tokens, nodes, examples) come from `documents` through a
deterministic tagger: parts of speech by word lists and endings, phrases of four tokens.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import sentence_parts, squeeze

#: Word lists of the tagger.
CONJUNCTIONS = ("and", "or", "but")
PREPOSITIONS = ("of", "in", "on", "at", "to", "with", "before", "after", "by", "from")
MODALS = ("should", "could", "would", "might", "may", "must", "can", "will", "shall")
HAVE_FORMS = ("have", "has", "had")
BE_FORMS = ("is", "are", "was", "were", "be", "been", "being")
POSSESSIVES = ("my", "your", "his", "her", "our", "their", "its")
PHRASE_TOKENS = 4
#: Part of speech, tag and dependency of the tagger's word classes.
WORD_CLASSES = (
    ("NOUN", "", "dep"), ("VERB", "VBG", "ROOT"), ("VERB", "VBN", "ROOT"), ("ADV", "", "dep"), ("DET", "", "det"), ("CCONJ", "", "dep"), ("ADP", "", "prep"), ("PRON", "", "poss"), ("AUX", "MD", "aux"), ("AUX", "", "aux"), ("AUX", "VBG", "aux"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder; only a local session, which has one machine, does without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}/checkpoints').rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """df written once to the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, sent_idx, seq, text: the sentences of all documents; seq orders them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", squeeze("text").alias("ntext"))
    parts = docs.select("doc_id", "source", "lang", F.posexplode(sentence_parts("ntext")).alias("sent_idx", "text")).where("text <> ''")
    return parts.select("doc_id", "source", "lang", "sent_idx", (F.col("doc_id") * 100_000 + F.col("sent_idx")).alias("seq"), "text")


def word_class(w):
    """A word's index in WORD_CLASSES: most words are in no list, so they cost one lookup and their ending."""
    listed = F.when(w == "the", 4).when(w.isin(*CONJUNCTIONS), 5).when(w.isin(*PREPOSITIONS), 6).when(w.isin(*POSSESSIVES), 7).when(w.isin(*MODALS), 8).when(w == "being", 10).otherwise(9)
    every = ("the", *CONJUNCTIONS, *PREPOSITIONS, *POSSESSIVES, *MODALS, *HAVE_FORMS, *BE_FORMS)
    return F.when(w.isin(*every), listed).when(w.endswith("ing"), 1).when(w.endswith("ed"), 2).when(w.endswith("ly"), 3).otherwise(0)


def class_of(w: str) -> int:
    """word_class of a word itself."""
    for k, listed in ((4, ("the",)), (5, CONJUNCTIONS), (6, PREPOSITIONS), (7, POSSESSIVES), (8, MODALS), (10, ("being",)), (9, HAVE_FORMS + BE_FORMS)):
        if w in listed:
            return k
    return 1 if w.endswith("ing") else 2 if w.endswith("ed") else 3 if w.endswith("ly") else 0


def tagged_sentences(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """doc_id, sent_idx, seq and the arrays toks, pos, tag, dep: a sentence with words is one row, tagged in place.

    dealt: sentences are dealt out by seq as texts, so that nothing keyed by the sentence is shuffled later.
    """
    # A filter on the words would be pushed below their extraction, which would then run twice.
    worded = sentences(spark, sf_dir).where(F.lower("text").rlike("[a-z']"))
    worded = worded.select("doc_id", "sent_idx", "seq", "text").repartition("seq") if dealt else worded
    s = worded.select("doc_id", "sent_idx", "seq", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0).alias("toks"))
    s = s.withColumn("_class", F.transform("toks", word_class))
    named = lambda k: F.transform("_class", lambda c: F.get(F.array(*[F.lit(x[k]) for x in WORD_CLASSES]), c))
    return s.select("doc_id", "sent_idx", "seq", "toks", named(0).alias("pos"), named(1).alias("tag"), named(2).alias("dep"))


def tokens(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """doc_id, sent_idx, seq, i, w, pos, tag, dep, phrase: the lower-cased words of every sentence; dealt as in tagged_sentences."""
    s = tagged_sentences(spark, sf_dir, dealt)
    words = s.select("doc_id", "sent_idx", "seq", F.posexplode(F.arrays_zip(F.col("toks").alias("w"), "pos", "tag", "dep")).alias("i", "x"))
    return words.select("doc_id", "sent_idx", "seq", "i", "x.w", "x.pos", "x.tag", "x.dep", F.floor(F.col("i") / PHRASE_TOKENS).cast("int").alias("phrase"))


def nodes(spark: SparkSession, sf_dir: str, dealt: bool = False, phrases: bool = False, **of_sentence: Column) -> DataFrame:
    """One row per node: doc_id, seq, sentence (its text), preorder, parent, depth, type, content, n_words, toks, pos, tag, dep, tam (bucket).

    phrases: also the lists of the phrase that a phrase or word belongs to (phrase_toks and so on; null for sentences).
    of_sentence: columns worked out once on the sentence's row (sentence and its lists) and carried to its nodes.

    A sentence's numbers are exploded and each node takes its slices of the sentence row's arrays: no shuffle, one scan, and only the columns that are read.
    """
    step, lists = PHRASE_TOKENS + 1, ("toks", "pos", "tag", "dep")
    n = F.size("toks")
    last = n + F.floor((n + PHRASE_TOKENS - 1) / PHRASE_TOKENS).cast("int")
    s = tagged_sentences(spark, sf_dir, dealt).withColumn("sentence", F.array_join("toks", " ")).withColumns(of_sentence)
    every = s.select("doc_id", "seq", "sentence", *lists, *of_sentence, F.explode(F.sequence(F.lit(0), last)).alias("preorder"))
    phrase, place = F.expr(f"CAST((preorder - 1) div {step} AS INT)"), F.expr(f"(preorder - 1) % {step}")
    at = lambda sentence, phrase, word: F.when(F.col("preorder") == 0, sentence).when(place == 0, phrase).otherwise(word)
    start = at(F.lit(1), phrase * PHRASE_TOKENS + 1, phrase * PHRASE_TOKENS + place)
    length = at(F.size("toks"), F.lit(PHRASE_TOKENS), F.lit(1))
    parts = every.select(
        "doc_id", "seq", "sentence", "preorder", at(F.lit(None), F.lit(0), phrase * step + 1).cast("int").alias("parent"), at(F.lit(0), F.lit(1), F.lit(2)).alias("depth"),
        at(F.lit("Sentence"), F.lit("Phrase"), F.lit("Word")).alias("type"), *[F.slice(c, start, length).alias(c) for c in lists],
        *of_sentence, *[F.when(F.col("preorder") > 0, F.slice(c, phrase * PHRASE_TOKENS + 1, F.lit(PHRASE_TOKENS))).alias(f"phrase_{c}") for c in lists if phrases],
    )
    return parts.select("doc_id", "seq", "sentence", "preorder", "parent", "depth", "type", F.array_join("toks", " ").alias("content"), F.size("toks").alias("n_words"), *lists, tam_of("toks").alias("tam"), *parts.columns[7 + len(lists):])


def tam_of(toks: str) -> Column:
    modal = F.arrays_overlap(toks, F.array(*[F.lit(x) for x in MODALS]))
    return F.when(F.array_contains(toks, "have") & modal, "modal_perfect").when(F.array_contains(toks, "had"), "past_perfect").otherwise("none")


def distinct_words(spark: SparkSession, sf_dir: str, *keys: str, **made: Column) -> DataFrame:
    """Word nodes that are equal, as one row with their number n, in all or by keys of `tokens` and columns made of its columns: keys, type, content, n_words, toks, pos, tag, dep, tam, n."""
    keys = (*keys, *made)
    words = tokens(spark, sf_dir).withColumns(made).groupBy(*keys, "w", "pos", "tag", "dep").agg(F.count(F.lit(1)).alias("n"))
    rows = words.select(*keys, F.lit("Word").alias("type"), F.col("w").alias("content"), F.lit(1).alias("n_words"), *[F.array(c).alias("toks" if c == "w" else c) for c in ("w", "pos", "tag", "dep")], "n")
    return rows.withColumn("tam", tam_of("toks"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, input, target, level, tam_bucket: a template id for every node."""
    from ..operators.dataset import template_id

    n = nodes(spark, sf_dir)
    return n.select((F.col("seq") * 100_000 + F.col("preorder")).alias("seq"), F.col("content").alias("input"), template_id().alias("target"), F.col("type").alias("level"), F.col("tam").alias("tam_bucket"))


def by_rank(df: DataFrame, order: str, digits: int = 3) -> DataFrame:
    """df with `rank`, the row's place in the order of a hex string column, with no global sort.

    Rows are ranked within buckets of the string's first digits; buckets, a few thousand, are summed up.
    """
    bucket = F.substring(order, 1, digits)
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.Window.partitionBy("_bucket").orderBy(order))
    # 16 ** digits rows at most: a proven bound.
    return dealt.join(F.broadcast(before), "_bucket").withColumn("rank", (inside + F.col("_before")).cast("long")).drop("_bucket", "_before")


def apart(df: DataFrame, *columns: Column) -> DataFrame:
    """df with further columns, worked out once: generated, so that they are not merged into the expressions that read them, which would repeat them and outgrow a compiled method."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SENTENCES = r"""
norm AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ntext FROM documents),
parts AS (SELECT doc_id, source, lang, string_split(regexp_replace(ntext, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS ps FROM norm),
raw AS (SELECT doc_id, source, lang, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS k FROM parts),
sentences AS (SELECT doc_id, source, lang, CAST(k AS INTEGER) AS sent_idx, CAST(doc_id * 100000 + k AS BIGINT) AS seq, text FROM raw WHERE text <> '')"""

TOKENS = (
    SENTENCES
    + f""",
words AS (SELECT doc_id, sent_idx, seq, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM sentences),
flat AS (SELECT doc_id, sent_idx, seq, unnest(ws) AS w, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS i FROM words),
tagged AS (SELECT *, CASE WHEN w = 'the' THEN 'DET' WHEN w IN ({sql_list(CONJUNCTIONS)}) THEN 'CCONJ' WHEN w IN ({sql_list(PREPOSITIONS)}) THEN 'ADP'
  WHEN w IN ({sql_list(POSSESSIVES)}) THEN 'PRON' WHEN w IN ({sql_list(MODALS + HAVE_FORMS + BE_FORMS)}) THEN 'AUX'
  WHEN suffix(w, 'ing') OR suffix(w, 'ed') THEN 'VERB' WHEN suffix(w, 'ly') THEN 'ADV' ELSE 'NOUN' END AS pos,
  CASE WHEN w IN ({sql_list(MODALS)}) THEN 'MD' WHEN suffix(w, 'ing') THEN 'VBG' WHEN suffix(w, 'ed') THEN 'VBN' ELSE '' END AS tag FROM flat),
tokens AS MATERIALIZED (SELECT *, CASE WHEN pos = 'DET' THEN 'det' WHEN pos = 'ADP' THEN 'prep' WHEN pos = 'AUX' THEN 'aux' WHEN pos = 'VERB' THEN 'ROOT'
  WHEN w IN ({sql_list(POSSESSIVES)}) THEN 'poss' ELSE 'dep' END AS dep, CAST(i // {PHRASE_TOKENS} AS INTEGER) AS phrase FROM tagged)"""
)

NODES = (
    TOKENS
    + f""",
pieces AS (
  SELECT doc_id, seq, 0 AS preorder, NULL::INTEGER AS parent, 0 AS depth, 'Sentence' AS type, list(w ORDER BY i) AS toks, list(pos ORDER BY i) AS pos, list(tag ORDER BY i) AS tag, list(dep ORDER BY i) AS dep FROM tokens GROUP BY doc_id, seq
  UNION ALL SELECT doc_id, seq, phrase * 5 + 1, 0, 1, 'Phrase', list(w ORDER BY i), list(pos ORDER BY i), list(tag ORDER BY i), list(dep ORDER BY i) FROM tokens GROUP BY doc_id, seq, phrase
  UNION ALL SELECT doc_id, seq, phrase * 5 + 2 + i % 4, phrase * 5 + 1, 2, 'Word', [w], [pos], [tag], [dep] FROM tokens),
nodes AS MATERIALIZED (SELECT *, array_to_string(toks, ' ') AS content, CAST(len(toks) AS INTEGER) AS n_words,
  CASE WHEN list_has_any(toks, [{sql_list(MODALS)}]) AND list_contains(toks, 'have') THEN 'modal_perfect' WHEN list_contains(toks, 'had') THEN 'past_perfect' ELSE 'none' END AS tam FROM pieces)"""
)

TEMPLATE_ID = f"""CASE
  WHEN type = 'Sentence' THEN CASE WHEN toks[1] IN ('before', 'after', 'when', 'while') THEN 'CLAUSE_SUBORDINATE_TIME' WHEN toks[1] IN ('because', 'since', 'as') THEN 'CLAUSE_SUBORDINATE_REASON'
    WHEN toks[1] IN ('although', 'though') THEN 'CLAUSE_SUBORDINATE_CONCESSION' ELSE 'SENTENCE_FINITE_CLAUSE' END
  WHEN type = 'Phrase' THEN CASE
    WHEN toks[1] = 'before' AND (list_contains(tag, 'VBG') OR len(list_filter(toks, lambda x: suffix(x, 'ing') AND length(x) > 4)) > 0) THEN 'PP_TIME_BEFORE_ING'
    WHEN list_contains(pos, 'ADP') THEN 'PP_GENERAL_LINKING' WHEN list_has_any(toks, [{sql_list(POSSESSIVES)}]) THEN 'NP_POSSESSIVE'
    WHEN list_contains(pos, 'DET') AND list_has_any(pos, ['NOUN', 'PROPN']) THEN 'NP_DETERMINER_NOUN'
    WHEN tam = 'modal_perfect' OR (list_has_any(toks, [{sql_list(MODALS)}]) AND list_contains(toks, 'have')) THEN 'VP_MODAL_PERFECT'
    WHEN list_contains(pos, 'AUX') THEN 'VP_AUXILIARY' WHEN list_contains(tag, 'VBN') THEN 'VP_PARTICIPLE' WHEN list_contains(pos, 'VERB') THEN 'VP_AUXILIARY' ELSE 'NP_DETERMINER_NOUN' END
  ELSE CASE WHEN pos[1] = 'AUX' AND toks[1] IN ({sql_list(MODALS)}) THEN 'WORD_AUX_MODAL' WHEN pos[1] = 'AUX' AND toks[1] = 'have' THEN 'WORD_AUX_HAVE'
    WHEN pos[1] = 'VERB' AND (tag[1] = 'VBG' OR (suffix(toks[1], 'ing') AND length(toks[1]) > 4)) THEN 'WORD_VERB_ING' WHEN pos[1] = 'VERB' AND tag[1] = 'VBN' THEN 'WORD_VERB_PARTICIPLE'
    WHEN pos[1] = 'PRON' AND dep[1] = 'poss' THEN 'WORD_PRONOUN_POSSESSIVE' WHEN pos[1] IN ('NOUN', 'PROPN') THEN 'WORD_NOUN_COMMON' WHEN pos[1] = 'DET' AND toks[1] = 'the' THEN 'WORD_ARTICLE_DEFINITE'
    WHEN pos[1] = 'ADP' THEN 'WORD_PREPOSITION' WHEN pos[1] = 'VERB' THEN 'WORD_VERB_PARTICIPLE' ELSE 'WORD_NOUN_COMMON' END END"""

EXAMPLES = NODES + f""",
examples AS (SELECT CAST(seq * 100000 + preorder AS BIGINT) AS seq, content AS input, {TEMPLATE_ID} AS target, type AS level, tam AS tam_bucket FROM nodes)"""


def sql(views: str, body: str) -> str:
    return f"WITH {views.strip()}{body}" if body.startswith(",") else f"WITH {views.strip()} {body}"
