"""Grammar: levels by rule and their calibration, tense and aspect, phrase spans, heads, inflection, synonyms, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans import views as V

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
#: Past participles that no ending gives, and word pairs of the idiomatic channel.
IRREGULAR = {
    "be": "been", "become": "become", "begin": "begun", "break": "broken", "bring": "brought", "buy": "bought", "come": "come", "do": "done", "drink": "drunk", "drive": "driven", "eat": "eaten", "fall": "fallen", "feel": "felt", "find": "found",
    "get": "gotten", "give": "given", "go": "gone", "know": "known", "leave": "left", "make": "made", "read": "read", "run": "run", "say": "said", "see": "seen", "speak": "spoken", "swear": "sworn", "take": "taken", "write": "written",
}
IDIOMATIC = (("необходимо", "нужно"), ("следует", "стоит"), ("должна была", "стоило бы"), ("должен был", "стоило бы"))


#: The highest level (from 0) of function words by class; classes of the tagger's tags.
CEILING = {"article": 0, "auxiliary verb": 1, "determiner": 1, "pronoun": 1, "preposition": 2, "conjunction": 2, "particle": 2}
CLASS_OF = {"DET": "article", "AUX": "auxiliary verb", "PRON": "pronoun", "ADP": "preposition", "CCONJ": "conjunction", "PART": "particle"}


def rule_level(kind: Column, text: Column, modal: Column, perfect: Column, nonfinite: Column) -> Column:
    """0-based level of a node: words by length and vowels, others by words, characters and verbal marks."""
    n = F.length(text)
    word = F.when(n >= 11, 2).when(n >= 8, 1).otherwise(0) + F.when(F.length(F.regexp_replace(F.lower(text), "[^aeiouy]", "")) >= 4, 1).otherwise(0)
    words = n - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    # Sums of conditions name each part once and have no branches: a repeated part is worked out once.
    marks = (words >= 20, words >= 12, words >= 7, n >= 120, n >= 70, modal, perfect, nonfinite)
    other = F.get(F.array(*[F.lit(x) for x in (1, 1, 2, 3, 3, 4, 5, 5, 5)]), sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0)))
    return F.when(kind == "Word", F.least(word, F.lit(3))).otherwise(other)


def level_name(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), i + 1)


def raw_level(kind: Column, text: Column, toks: str = "toks", pos: str = "pos", tag: str = "tag") -> Column:
    """The rule's level of a node with these lists."""
    has = lambda c, xs: F.arrays_overlap(c, F.array(*[F.lit(x) for x in xs]))
    # The lambda keeps the projection out of whole-stage code: as one method it is too large to be compiled, which takes three times as long.
    perfect = F.exists(toks, lambda x: x.isin(*V.HAVE_FORMS)) & F.array_contains(tag, "VBN")
    return rule_level(kind, text, has(toks, V.MODALS), perfect, ~has(pos, ("AUX", "VERB"))).cast("int")


def levelled(spark: SparkSession, sf: str) -> DataFrame:
    n = V.nodes(spark, sf)
    return n.select("seq", "preorder", "parent", "type", "content", F.get("pos", F.lit(0)).alias("p"), raw_level(F.col("type"), F.col("content")).alias("raw"))


def cefr_rule_level(spark: SparkSession, sf: str) -> DataFrame:
    return levelled(spark, sf).groupBy("type", level_name(F.col("raw")).alias("cefr_level")).agg(F.count(F.lit(1)).alias("n"))


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Level by level: a phrase within one of its sentence; a word below its class's ceiling, the sentence + 2 and its phrase + 1.

    seq, preorder, parent, type, p, level, s (the sentence's level), up (the level of the phrase, for phrases and words).  The sentence's level is worked out on its row and
    the phrase's from the words around a word, so levels above a node need no join.
    """
    n = V.nodes(spark, sf, phrases=True, s=raw_level(F.lit("Sentence"), F.col("sentence")))
    # The tagger's DET is the article.
    ceiling = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CEILING.items() for x in kv]), F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASS_OF.items() for x in kv]), F.col("p"))), F.lit(5))
    phrase = raw_level(F.lit("Phrase"), F.array_join("phrase_toks", " "), "phrase_toks", "phrase_pos", "phrase_tag")
    up = F.least(F.greatest(phrase, F.col("s") - 1), F.col("s") + 1, F.lit(5))
    n = n.select("doc_id", "seq", "preorder", "parent", "type", F.get("pos", F.lit(0)).alias("p"), F.when(F.col("type") == "Word", raw_level(F.lit("Word"), F.col("content"))).alias("raw"), "s", F.when(F.col("type") != "Sentence", up).alias("up"))
    word = F.least("raw", ceiling, F.col("s") + 2, F.col("up") + 1, F.lit(5))
    return n.withColumn("level", F.when(F.col("type") == "Word", word).when(F.col("type") == "Phrase", F.col("up")).otherwise(F.col("s"))).drop("raw")


def cefr_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf).groupBy("type", level_name(F.col("level")).alias("cefr_level")).agg(F.count(F.lit(1)).alias("n"))


def verbal(spark: SparkSession, sf: str) -> DataFrame:
    """Of each sentence: modal, perfect, progressive, passive, tense and the construction that follows."""
    t = V.tokens(spark, sf)
    w = F.col("w")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = t.groupBy("seq").agg(
        F.min_by("w", F.when(F.col("tag") == "MD", F.col("i"))).alias("modal"), any_of(w.isin(*V.HAVE_FORMS)).alias("have"), any_of(w.isin(*V.BE_FORMS)).alias("be"), any_of(w == "being").alias("being"),
        any_of(F.col("tag") == "VBN").alias("vbn"), any_of(F.col("tag") == "VBG").alias("vbg"), any_of(w.isin("not", "never")).alias("neg"),
        F.min_by("w", F.when(F.col("pos") == "AUX", F.col("i"))).alias("first"),
    )
    has_modal = F.col("modal").isNotNull()
    perfect, progressive = F.col("have") & F.col("vbn"), (F.col("be") & F.col("vbg")) | (F.col("being") & F.col("vbn"))
    future = F.coalesce(F.col("modal").isin("will", "shall"), F.lit(False))
    tense = F.when(future, "future").when(has_modal & F.col("have") & F.col("vbn"), "none").when(F.col("first").isin("had", "was", "were"), "past").when(F.col("first").isNotNull(), "present").otherwise("none")
    aspect = F.when(perfect & progressive, "perfect progressive").when(perfect, "perfect").when(progressive, "progressive").otherwise("simple")
    construction = F.when(has_modal & perfect & ~future, "modal_perfect").when(perfect & (tense == "past") & ~has_modal, "past_perfect").when(perfect & (tense == "present") & ~has_modal, "present_perfect").when(perfect & future, "future_perfect").otherwise("none")
    stored = F.when(tense == "none", F.lit(None)).when(aspect == "simple", tense).otherwise(F.concat(tense, F.lit(" "), aspect))
    return g.select(
        "seq", F.when(has_modal, "modal").otherwise("indicative").alias("mood"), F.when(F.col("be") & F.col("vbn"), "passive").otherwise("active").alias("voice"),
        F.when(F.col("neg"), "negative").otherwise("affirmative").alias("polarity"), aspect.alias("aspect"), construction.alias("construction"), stored.alias("tense"),
    )


def tam_detect(spark: SparkSession, sf: str) -> DataFrame:
    return verbal(spark, sf)


def skeleton_phrase_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate spans of noun runs, verb groups and prepositions to the end of their phrase; first kind wins for a span, simple determiner phrases go."""
    t = V.tokens(spark, sf)
    run = W.Window.partitionBy("seq", "nominal").orderBy("i")
    nominal = F.col("pos").isin("DET", "NOUN", "PRON")
    n = t.withColumn("nominal", nominal).withColumn("island", F.col("i") - F.row_number().over(run)).where("nominal")
    np = n.groupBy("seq", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count(F.lit(1)).alias("len"), F.min_by("pos", "i").alias("head"), F.bool_or(F.col("pos") == "PRON").alias("pron"))
    np = np.where(~((F.col("len") >= 2) & (F.col("head") == "DET") & ~F.col("pron"))).select("seq", "a", "b", F.lit(1).alias("rank"), F.lit("noun phrase").alias("kind"))
    vp = t.where(F.col("pos").isin("AUX", "VERB", "ADV")).groupBy("seq", "phrase").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.bool_or(F.col("pos") != "ADV").alias("v")).where("v").select("seq", "a", "b", F.lit(2).alias("rank"), F.lit("verb phrase").alias("kind"))
    ends = t.groupBy("seq", "phrase").agg(F.max("i").alias("b"))
    pp = t.where("pos = 'ADP'").join(ends, ["seq", "phrase"]).select("seq", F.col("i").alias("a"), "b", F.lit(3).alias("rank"), F.lit("prepositional phrase").alias("kind"))
    every = np.unionByName(vp).unionByName(pp)
    return every.groupBy("seq", "a", "b").agg(F.min_by("kind", "rank").alias("kind"))


def head_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each token's head within its phrase: the phrase's first verb; none for that verb or without one."""
    t = V.tokens(spark, sf)
    heads = t.where("pos in ('VERB', 'AUX')").groupBy("seq", "phrase").agg(F.min("i").alias("head"))
    j = t.join(heads, ["seq", "phrase"], "left")
    return j.groupBy("seq").agg(F.count_if(F.col("head") != F.col("i")).alias("attached"), F.count_if(F.col("head").isNull()).alias("headless"), F.sum(F.coalesce("head", F.lit(0))).alias("head_sum"))


def past_participle(w: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    regular = F.when(w.endswith("e"), F.concat(w, F.lit("d"))).when(w.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(w, "y$", ""), F.lit("ied"))).otherwise(F.concat(w, F.lit("ed")))
    return F.coalesce(F.try_element_at(table, w), regular)


def verb_inflect(spark: SparkSession, sf: str) -> DataFrame:
    return V.tokens(spark, sf).select("w").distinct().select("w", past_participle(F.col("w")).alias("participle"))


def synonym_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates without the word itself and repeats, whatever their case; the first three stay in order."""
    n = V.nodes(spark, sf).where("type = 'Phrase'")
    values = F.transform("toks", lambda x, i: F.when(i % 2 == 0, F.upper(x)).otherwise(x))
    first = F.lower(F.get("toks", F.lit(0)))
    keep = F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when((F.lower(x) == first) | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return n.select("seq", "preorder", F.array_join(F.slice(keep, 1, 3), ",").alias("synonyms"))


def idiomatic(text: Column, lang: Column) -> Column:
    out = text
    for old, new in IDIOMATIC:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.lower(F.trim(lang)) == "ru", out).otherwise(text)


def dual_channels(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf)
    target = F.when(F.col("seq") % 2 == 0, "ru").otherwise("de")
    text = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("необходимо следует "), F.trim("text"))).otherwise(F.trim("text"))
    return s.select("seq", F.sha2(text, 256).alias("literary"), F.sha2(idiomatic(text, target), 256).alias("idiomatic"))


QUERIES = {f.__name__: f for f in (cefr_rule_level, cefr_calibrated, tam_detect, skeleton_phrase_spans, head_resolution, verb_inflect, synonym_normalize, dual_channels)}

LEVELLED = V.NODES + f""",
marks AS (SELECT *, CAST(list_has_any(toks, [{V.sql_list(V.MODALS)}]) AS INTEGER) + CAST(list_has_any(toks, [{V.sql_list(V.HAVE_FORMS)}]) AND list_contains(tag, 'VBN') AS INTEGER) + CAST(NOT list_has_any(pos, ['AUX', 'VERB']) AS INTEGER) AS extra FROM nodes),
scored AS (SELECT *, CASE WHEN type = 'Word' THEN CASE WHEN length(content) >= 11 THEN 2 WHEN length(content) >= 8 THEN 1 ELSE 0 END + CASE WHEN length(regexp_replace(content, '[^aeiouy]', '', 'g')) >= 4 THEN 1 ELSE 0 END
  ELSE CASE WHEN n_words >= 20 THEN 3 WHEN n_words >= 12 THEN 2 WHEN n_words >= 7 THEN 1 ELSE 0 END + CASE WHEN length(content) >= 120 THEN 2 WHEN length(content) >= 70 THEN 1 ELSE 0 END + extra END AS score FROM marks),
levelled AS (SELECT *, CASE WHEN type = 'Word' THEN least(score, 3) WHEN score <= 1 THEN 1 WHEN score = 2 THEN 2 WHEN score <= 4 THEN 3 WHEN score = 5 THEN 4 ELSE 5 END AS raw FROM scored)"""
CALIBRATED = LEVELLED + """,
tops AS (SELECT seq, raw AS s FROM levelled WHERE type = 'Sentence'),
ph AS (SELECT seq, preorder, parent, type, pos, least(greatest(raw, s - 1), least(s + 1, 5)) AS level, s FROM levelled JOIN tops USING (seq) WHERE type = 'Phrase'),
wo AS (SELECT l.seq, l.preorder, l.parent, l.type, l.pos, least(l.raw, CASE WHEN l.pos[1] = 'DET' THEN 0 WHEN l.pos[1] IN ('AUX', 'PRON') THEN 1 WHEN l.pos[1] IN ('ADP', 'CCONJ') THEN 2 ELSE 5 END, ph.s + 2, ph.level + 1, 5) AS level, ph.s
  FROM levelled l JOIN ph ON l.seq = ph.seq AND l.parent = ph.preorder WHERE l.type = 'Word'),
calibrated AS (SELECT seq, preorder, parent, type, pos, raw AS level, raw AS s FROM levelled WHERE type = 'Sentence' UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM wo)"""
_NAMES = "['A1', 'A2', 'B1', 'B2', 'C1', 'C2']"
_HAS = lambda xs: f"bool_or(w IN ({V.sql_list(xs)}))"

ORACLES = {
    "cefr_rule_level": V.sql(LEVELLED, f"SELECT type, ({_NAMES})[raw + 1] AS cefr_level, count(*) AS n FROM levelled GROUP BY 1, 2"),
    "cefr_calibrated": V.sql(CALIBRATED, f"SELECT type, ({_NAMES})[level + 1] AS cefr_level, count(*) AS n FROM calibrated GROUP BY 1, 2"),
    "tam_detect": V.sql(V.TOKENS, f""", g AS (SELECT seq, arg_min(w, i) FILTER (tag = 'MD') AS modal, {_HAS(V.HAVE_FORMS)} AS have, {_HAS(V.BE_FORMS)} AS be, bool_or(w = 'being') AS being, bool_or(tag = 'VBN') AS vbn, bool_or(tag = 'VBG') AS vbg,
        {_HAS(('not', 'never'))} AS neg, arg_min(w, i) FILTER (pos = 'AUX') AS f FROM tokens GROUP BY seq),
      h AS (SELECT *, have AND vbn AS perf, (be AND vbg) OR (being AND vbn) AS prog, coalesce(modal IN ('will', 'shall'), false) AS fut FROM g),
      k AS (SELECT *, CASE WHEN fut THEN 'future' WHEN modal IS NOT NULL AND perf THEN 'none' WHEN f IN ('had', 'was', 'were') THEN 'past' WHEN f IS NOT NULL THEN 'present' ELSE 'none' END AS ten,
        CASE WHEN perf AND prog THEN 'perfect progressive' WHEN perf THEN 'perfect' WHEN prog THEN 'progressive' ELSE 'simple' END AS aspect FROM h)
      SELECT seq, CASE WHEN modal IS NOT NULL THEN 'modal' ELSE 'indicative' END AS mood, CASE WHEN be AND vbn THEN 'passive' ELSE 'active' END AS voice, CASE WHEN neg THEN 'negative' ELSE 'affirmative' END AS polarity, aspect,
        CASE WHEN modal IS NOT NULL AND perf AND NOT fut THEN 'modal_perfect' WHEN perf AND ten = 'past' AND modal IS NULL THEN 'past_perfect' WHEN perf AND ten = 'present' AND modal IS NULL THEN 'present_perfect' WHEN perf AND fut THEN 'future_perfect' ELSE 'none' END AS construction,
        CASE WHEN ten = 'none' THEN NULL WHEN aspect = 'simple' THEN ten ELSE ten || ' ' || aspect END AS tense FROM k"""),
    "skeleton_phrase_spans": V.sql(V.TOKENS, """, isl AS (SELECT *, i - row_number() OVER (PARTITION BY seq ORDER BY i) AS island FROM tokens WHERE pos IN ('DET', 'NOUN', 'PRON')),
      np AS (SELECT seq, min(i) AS a, max(i) AS b, 1 AS rank, 'noun phrase' AS kind FROM isl GROUP BY seq, island HAVING NOT (count(*) >= 2 AND arg_min(pos, i) = 'DET' AND NOT bool_or(pos = 'PRON'))),
      vp AS (SELECT seq, min(i) AS a, max(i) AS b, 2 AS rank, 'verb phrase' AS kind FROM tokens WHERE pos IN ('AUX', 'VERB', 'ADV') GROUP BY seq, phrase HAVING bool_or(pos <> 'ADV')),
      pp AS (SELECT seq, i AS a, max(i) OVER (PARTITION BY seq, phrase) AS b, pos FROM tokens), every AS (SELECT * FROM np UNION ALL SELECT * FROM vp UNION ALL SELECT seq, a, b, 3, 'prepositional phrase' FROM pp WHERE pos = 'ADP')
      SELECT seq, a, b, arg_min(kind, rank) AS kind FROM every GROUP BY seq, a, b"""),
    "head_resolution": V.sql(V.TOKENS, """, h AS (SELECT *, min(CASE WHEN pos IN ('VERB', 'AUX') THEN i END) OVER (PARTITION BY seq, phrase) AS head FROM tokens)
      SELECT seq, count(*) FILTER (head <> i) AS attached, count(*) FILTER (head IS NULL) AS headless, CAST(sum(coalesce(head, 0)) AS BIGINT) AS head_sum FROM h GROUP BY seq"""),
    "verb_inflect": V.sql(V.TOKENS, ", irregular AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR.items()) + """) t(v, p))
      SELECT DISTINCT w, coalesce(p, CASE WHEN suffix(w, 'e') THEN w || 'd' WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:-2] || 'ied' ELSE w || 'ed' END) AS participle FROM tokens LEFT JOIN irregular ON w = v"""),
    "synonym_normalize": V.sql(V.NODES, """, u AS (SELECT seq, preorder, toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS k FROM nodes WHERE type = 'Phrase'),
      f AS (SELECT seq, preorder, t, min(k) AS k FROM u WHERE t <> toks[1] GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY seq, preorder ORDER BY k) AS r FROM f),
      x AS (SELECT seq, preorder, string_agg(CASE WHEN k % 2 = 1 THEN upper(t) ELSE t END, ',' ORDER BY k) AS s FROM r WHERE r <= 3 GROUP BY 1, 2)
      SELECT n.seq, CAST(n.preorder AS INTEGER) AS preorder, coalesce(s, '') AS synonyms FROM nodes n LEFT JOIN x USING (seq, preorder) WHERE n.type = 'Phrase'"""),
    "dual_channels": V.sql(V.SENTENCES, """, l AS (SELECT seq, CASE WHEN seq % 4 = 0 THEN 'необходимо следует ' || trim(text) ELSE trim(text) END AS t FROM sentences)
      SELECT seq, sha256(t) AS literary, sha256(CASE WHEN seq % 2 = 0 THEN replace(replace(replace(replace(t, 'необходимо', 'нужно'), 'следует', 'стоит'), 'должна была', 'стоило бы'), 'должен был', 'стоило бы') ELSE t END) AS idiomatic FROM l"""),
}
