"""Training sets: templates, targets, prompts, deduplication, caps, balance, splits, statistics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..plans import views as V

#: Notes of the template ids.
TEMPLATE_NOTES = {
    "SENTENCE_FINITE_CLAUSE": "This is a finite clause expressing a complete proposition.",
    "CLAUSE_SUBORDINATE_TIME": "This clause marks a time relation inside the sentence.",
    "CLAUSE_SUBORDINATE_REASON": "This clause expresses a reason for the main event.",
    "CLAUSE_SUBORDINATE_CONCESSION": "This clause marks concession against the main statement.",
    "VP_MODAL_PERFECT": "This verb phrase shows modal meaning with perfect aspect.",
    "VP_AUXILIARY": "This verb phrase uses an auxiliary to support tense or mood.",
    "VP_PARTICIPLE": "This verb phrase is built around a participle form.",
    "NP_POSSESSIVE": "This noun phrase marks possession inside the noun group.",
    "NP_DETERMINER_NOUN": "This noun phrase combines a determiner with a noun head.",
    "PP_TIME_BEFORE_ING": "This prepositional phrase marks time with 'before' plus an -ing form.",
    "PP_GENERAL_LINKING": "This prepositional phrase links a complement to the clause.",
    "WORD_AUX_MODAL": "This word is a modal auxiliary marking speaker stance or obligation.",
    "WORD_AUX_HAVE": "This word is auxiliary 'have' supporting perfect construction.",
    "WORD_VERB_PARTICIPLE": "This word is a participle verb form in the verbal group.",
    "WORD_PRONOUN_POSSESSIVE": "This word is a possessive pronoun or determiner in a noun phrase.",
    "WORD_NOUN_COMMON": "This word is a common noun naming an entity in context.",
    "WORD_ARTICLE_DEFINITE": "This word is the definite article specifying a known referent.",
    "WORD_PREPOSITION": "This word is a preposition linking a complement to another element.",
    "WORD_VERB_ING": "This word is an -ing verb form with non-finite function.",
}
#: Openers of subordinate clauses.
TIME_OPENERS, REASON_OPENERS, CONCESSION_OPENERS = ("before", "after", "when", "while"), ("because", "since", "as"), ("although", "though")


def template_id() -> Column:
    """Template id of a node row (type, toks, pos, tag, dep, tam): ordered rules, first match wins."""
    first, p, level = F.get("toks", F.lit(0)), F.get("pos", F.lit(0)), F.col("type")
    # No lambdas: they are interpreted for every element, and the whole projection is not compiled.
    has = lambda c, *xs: F.arrays_overlap(c, F.array(*[F.lit(x) for x in xs]))
    gerund = F.array_contains("tag", "VBG") | F.array_join("toks", "\u0001").rlike("[^\u0001]{2}ing(?:\u0001|\\z)")
    participle = F.array_contains("tag", "VBN")
    noun, have = has("pos", "NOUN", "PROPN"), F.array_contains("toks", "have")
    modal = has("toks", *V.MODALS)
    sentence = F.when(first.isin(*TIME_OPENERS), "CLAUSE_SUBORDINATE_TIME").when(first.isin(*REASON_OPENERS), "CLAUSE_SUBORDINATE_REASON").when(first.isin(*CONCESSION_OPENERS), "CLAUSE_SUBORDINATE_CONCESSION").otherwise("SENTENCE_FINITE_CLAUSE")
    phrase = (
        F.when((first == "before") & gerund, "PP_TIME_BEFORE_ING").when(F.array_contains("pos", "ADP"), "PP_GENERAL_LINKING").when(has("toks", *V.POSSESSIVES), "NP_POSSESSIVE")
        .when(F.array_contains("pos", "DET") & noun, "NP_DETERMINER_NOUN").when((F.col("tam") == "modal_perfect") | (modal & have), "VP_MODAL_PERFECT")
        .when(F.array_contains("pos", "AUX"), "VP_AUXILIARY").when(participle, "VP_PARTICIPLE").when(F.array_contains("pos", "VERB"), "VP_AUXILIARY").otherwise("NP_DETERMINER_NOUN")
    )
    word = (
        F.when((p == "AUX") & modal, "WORD_AUX_MODAL").when((p == "AUX") & have, "WORD_AUX_HAVE").when((p == "VERB") & gerund, "WORD_VERB_ING").when((p == "VERB") & participle, "WORD_VERB_PARTICIPLE")
        .when((p == "PRON") & F.array_contains("dep", "poss"), "WORD_PRONOUN_POSSESSIVE").when(noun, "WORD_NOUN_COMMON").when((p == "DET") & (first == "the"), "WORD_ARTICLE_DEFINITE")
        .when(p == "ADP", "WORD_PREPOSITION").when(p == "VERB", "WORD_VERB_PARTICIPLE").otherwise("WORD_NOUN_COMMON")
    )
    return F.when(level == "Sentence", sentence).when(level == "Phrase", phrase).otherwise(word)


def template_id_classify(spark: SparkSession, sf: str) -> DataFrame:
    return V.examples(spark, sf).groupBy("level", F.col("target").alias("template_id")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def template_target() -> Column:
    notes = F.create_map(*[F.lit(x) for kv in TEMPLATE_NOTES.items() for x in kv])
    return F.concat("target", F.lit("|"), F.try_element_at(notes, F.col("target")))


def template_target_render(spark: SparkSession, sf: str) -> DataFrame:
    e = V.examples(spark, sf).withColumn("rendered", template_target())
    return e.groupBy("rendered").agg(F.count(F.lit(1)).alias("n"))


def reference_note_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the variants of a reference note a node takes, by a hash of its parts."""
    n = V.nodes(spark, sf)
    modulus = F.when(F.col("type") == "Word", 3).otherwise(2)
    digest = F.sha2(F.concat("type", F.lit("|"), "content", F.lit("|"), "tam"), 256)
    index = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % modulus).cast("int")
    return n.groupBy("type", index.alias("variant")).agg(F.count(F.lit(1)).alias("n"))


def target_sanitize_reason(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).select("text").union(V.read(spark, sf, "benchmark").select("text"))
    return s.groupBy(F.coalesce(T.target_reason("text"), F.lit("KEPT")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def hard_rule_filter(spark: SparkSession, sf: str) -> DataFrame:
    return V.sentences(spark, sf).groupBy("lang").agg(F.count_if(T.hard_rule_ok("text")).alias("kept"), F.count_if(~T.hard_rule_ok("text")).alias("refused"))


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of the three levels; a list feature is joined by commas, its bars read as colons."""
    n = V.nodes(spark, sf)
    feature = lambda c: F.replace(F.array_join(c, ", "), F.lit("|"), F.lit(":"))
    first = lambda c: F.coalesce(F.nullif(F.trim(F.get(c, F.lit(0))), F.lit("")), F.lit("UNKNOWN"))
    word = F.concat(F.lit("task: write a note level: word word: "), "content", F.lit(" pos: "), first("pos"), F.lit(" tag: "), first("tag"), F.lit(" dep: "), first("dep"))
    other = F.concat(F.lit("task: write a note level: "), F.lower("type"), F.lit(" text: "), "content", F.lit(" pos: "), feature("pos"), F.lit(" dep: "), feature("dep"), F.lit(" tam: "), "tam")
    return n.select("seq", "preorder", F.sha2(F.when(F.col("type") == "Word", word).otherwise(other), 256).alias("prompt_sha256"))


def legacy_prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    n = V.nodes(spark, sf).where("type = 'Phrase'")
    prompt = F.concat(F.lit("pos: "), F.array_join("pos", ", "), F.lit(" dep: "), F.array_join("dep", ", "), F.lit(" sentence: "), "sentence", F.lit(" chunk: "), "content")
    return n.select("seq", "preorder", F.sha2(prompt, 256).alias("prompt_sha256"))


def deduplicated(e: DataFrame) -> DataFrame:
    """First row of each (input, target key) in order."""
    keyed = e.withColumn("key", T.norm_key("target"))
    first = F.min_by(F.struct("seq", "target", "level", "tam_bucket"), F.col("seq")).alias("x")
    return keyed.groupBy("input", "key").agg(first).select("input", "key", "x.seq", "x.target", "x.level", "x.tam_bucket")


def capped(e: DataFrame, cap: int) -> DataFrame:
    """After deduplication the first `cap` rows of each target key; the rank filter becomes a limit within tasks, so hot keys shrink before the shuffle."""
    rank = F.row_number().over(W.Window.partitionBy("key").orderBy("seq"))
    return deduplicated(e).withColumn("rank", rank).where(F.col("rank") <= cap)


def dedup_exact_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(V.examples(spark, sf)).select("seq", "input", "target")


def cap_per_target(spark: SparkSession, sf: str) -> DataFrame:
    return capped(V.examples(spark, sf), 20).select("seq", "target", "rank")


def dedup_cap_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept, exact duplicates (of rows that were kept) and capped rows, at a cap of 20."""
    e = V.examples(spark, sf).withColumn("key", T.norm_key("target"))
    pairs = e.groupBy("input", "key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("copies"))
    kept = capped(V.examples(spark, sf), 20).select("input", "key", F.lit(1).alias("kept"))
    sums = pairs.join(kept, ["input", "key"], "left").agg(F.sum("copies").alias("total"), F.count("kept").alias("kept"), F.sum(F.when(F.col("kept") == 1, F.col("copies") - 1).otherwise(0)).alias("exact"))
    return sums.select("total", "kept", F.col("exact").alias("exact_duplicates"), (F.col("total") - F.col("kept") - F.col("exact")).alias("capped"))


def _hashed(e: DataFrame) -> DataFrame:
    return e.withColumn("h", F.md5(F.concat(F.lit("42|"), F.col("seq").cast("string"))))


def balanced(e: DataFrame) -> DataFrame:
    """Per level every bucket as large as the level's smallest, chosen by hash; a level with one bucket stays."""
    sizes = e.groupBy("level", "tam_bucket").agg(F.count(F.lit(1)).alias("n"))
    least = sizes.groupBy("level").agg(F.min("n").alias("least"))  # one row per level
    # Ranks by hash within strata, in two steps so that a large stratum is not one task's.
    h = _hashed(e)
    bucket = F.substring("h", 1, 2)
    inside = F.row_number().over(W.Window.partitionBy("level", "tam_bucket", "b").orderBy("h"))
    counts = h.groupBy("level", "tam_bucket", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("level", "tam_bucket", "b", F.coalesce(F.sum("n").over(W.Window.partitionBy("level", "tam_bucket").orderBy("b").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = h.withColumn("b", bucket).withColumn("r", inside).join(before, ["level", "tam_bucket", "b"]).join(F.broadcast(least), "level")
    return ranked.where(F.col("r") + F.col("before") <= F.col("least")).select("seq", "input", "target", "level", "tam_bucket")


def balance_level_tam(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(V.examples(spark, sf)).select("seq", "level", "tam_bucket")


def split(e: DataFrame, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """A `split` for each row, by hash order: test first, then dev, the rest train; sizes are truncated shares of the count."""
    n = e.agg(F.count(F.lit(1)).alias("n"))
    ranked = V.by_rank(_hashed(e), "h").crossJoin(F.broadcast(n))
    n_test, n_dev = F.floor(F.col("n") * test), F.floor(F.col("n") * dev)
    return ranked.withColumn("split", F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_dev, "dev").otherwise("train")).drop("n", "h", "rank")


def split_train_dev_test(spark: SparkSession, sf: str) -> DataFrame:
    return split(V.examples(spark, sf)).select("seq", "split")


def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return split(deduplicated(V.examples(spark, sf))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_per_stratum(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 rows of each (level, target), by hash."""
    r = F.row_number().over(W.Window.partitionBy("level", "target").orderBy("h"))
    return _hashed(V.examples(spark, sf)).withColumn("r", r).where("r <= 100").select("seq", "level", "target")


def within(df: DataFrame, strata: list[str], order: str, first: int, digits: int = 2) -> DataFrame:
    """df without the rows that are surely not among the first ones of their stratum in the order of a hex string column.

    Rows are counted by the string's first digits; later digits than those that hold the first rows are left out before any sort.
    """
    digit = F.substring(order, 1, digits)
    counts = df.groupBy(*strata, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*strata, "_digit", F.coalesce(F.sum("_n").over(W.Window.partitionBy(*strata).orderBy("_digit").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = before.where(F.col("_before") < first).groupBy(*strata).agg(F.max("_digit").alias("_last"))
    # One row a stratum, and strata are names of levels and templates.
    return df.join(F.broadcast(last), strata).where(digit <= F.col("_last")).drop("_last")


#: Sizes of the bootstrap's splits for each stratum.
BOOTSTRAP = (("train", 1200), ("dev", 200), ("test", 200))


def bootstrap_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Of each (level, target), in hash order, the first rows to train, the next to dev and to test."""
    sizes = dict(BOOTSTRAP)
    r = F.row_number().over(W.Window.partitionBy("level", "target").orderBy("h"))
    ranked = within(_hashed(V.examples(spark, sf)), ["level", "target"], "h", sum(sizes.values())).withColumn("r", r).where(F.col("r") <= sum(sizes.values()))
    split = F.when(F.col("r") <= sizes["train"], "train").when(F.col("r") <= sizes["train"] + sizes["dev"], "dev").otherwise("test")
    return ranked.groupBy("level", "target", split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))


def count_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return V.examples(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def level_tam_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return V.examples(spark, sf).groupBy("level", "tam_bucket").agg(F.count(F.lit(1)).alias("n"))


def level_tam_cube(spark: SparkSession, sf: str) -> DataFrame:
    return V.examples(spark, sf).cube("level", "tam_bucket").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def target_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = V.examples(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.countDistinct(T.norm_key("target")).alias("unique_targets"))
    return s.withColumn("duplicate_ratio", F.round(1 - F.col("unique_targets") / F.col("total"), 6))


def target_topk(spark: SparkSession, sf: str) -> DataFrame:
    g = V.examples(spark, sf).groupBy(T.norm_key("target").alias("target")).agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first"))
    return g.orderBy(F.desc("count"), "first").limit(15).select("target", "count")


def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Failed gates of the balanced set: unique targets, share of the first, active template ids."""
    g = V.examples(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("top"), F.count_if((F.col("target") != "none") & (F.col("n") > 0)).alias("active"))
    share = F.col("top") / F.col("total")
    return s.select("total", "unique", "active", (F.col("unique") < 20).alias("fails_unique"), (share > 0.3).alias("fails_top1"), (F.col("active") < 15).alias("fails_active"), F.round(share, 6).alias("top1_share"))


def mix_feedback(base: DataFrame, feedback: DataFrame, weight: int) -> DataFrame:
    """base and `weight` copies of feedback; a negative weight is an error."""
    if weight < 0:
        raise ValueError("feedback weight must not be negative")
    return base if weight == 0 else base.unionByName(feedback.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(weight)))).drop("_copy"))


def feedback_mix_weighted(spark: SparkSession, sf: str) -> DataFrame:
    e = V.examples(spark, sf).select("level", "target")
    return mix_feedback(e.where("level <> 'Word'"), e.where("level = 'Word'"), 3).groupBy("level", "target").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    template_id_classify, template_target_render, reference_note_variant, target_sanitize_reason, hard_rule_filter, prompt_render, legacy_prompt_render, dedup_exact_pairs,
    cap_per_target, dedup_cap_report, balance_level_tam, split_train_dev_test, split_sizes, bootstrap_per_stratum, bootstrap_splits, count_by_level, level_tam_matrix, level_tam_cube, target_stats, target_topk,
    quality_gates, feedback_mix_weighted,
)}

_RX = lambda ps, c: " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in ps)
_COUNT = "len(list_filter(string_split_regex({c}, '[.!?]+'), lambda s: trim(s) <> ''))"
_HARD = (
    "(len(string_split(text, ' ')) <= 30 AND " + _COUNT.format(c="text") + " BETWEEN 1 AND 2 AND NOT (" + " OR ".join(f"starts_with(lower(text), '{p}')" for p in T.BANNED_PREFIXES) + " OR "
    + " OR ".join(f"contains(lower(text), '{p}')" for p in T.BANNED_SUBSTRINGS) + r") AND NOT regexp_matches(text, '[<{].*[>}]') AND NOT regexp_matches(lower(text), '\b(i|you|we|llm|chatgpt|model)\b'))"
)
_NOTES = "(VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATE_NOTES.items()) + ") AS notes(id, note)"
_DEDUP = V.EXAMPLES + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY input, lower(target) ORDER BY seq) AS r FROM examples), dedup AS (SELECT * FROM ranked WHERE r = 1)"
_CAP = _DEDUP + ", caps AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq) AS k FROM dedup)"

ORACLES = {
    "template_id_classify": V.sql(V.EXAMPLES, "SELECT level, target AS template_id, count(*) AS n, min(seq) AS first_seq FROM examples GROUP BY ALL"),
    "template_target_render": V.sql(V.EXAMPLES, f"SELECT target || '|' || note AS rendered, count(*) AS n FROM examples JOIN {_NOTES} ON target = id GROUP BY 1"),
    "reference_note_variant": V.sql(V.NODES, "SELECT type, CAST(('0x' || substr(sha256(type || '|' || content || '|' || tam), 1, 8))::BIGINT % CASE WHEN type = 'Word' THEN 3 ELSE 2 END AS INTEGER) AS variant, count(*) AS n FROM nodes GROUP BY 1, 2"),
    "target_sanitize_reason": V.sql(V.SENTENCES, f""", notes AS (SELECT trim(text) AS t FROM sentences UNION ALL SELECT trim(text) FROM benchmark)
      SELECT CASE WHEN t = '' THEN 'EMPTY' WHEN {_RX(T.TELEMETRY, 't')} THEN 'TELEMETRY' WHEN {_RX(T.LOW_QUALITY, 't')} OR NOT {_COUNT.format(c='t')} BETWEEN 1 AND 2 THEN 'LOW_QUALITY_STYLE' ELSE 'KEPT' END AS reason, count(*) AS n FROM notes GROUP BY 1"""),
    "hard_rule_filter": V.sql(V.SENTENCES, f"SELECT lang, count(*) FILTER ({_HARD}) AS kept, count(*) FILTER (NOT {_HARD}) AS refused FROM sentences GROUP BY lang"),
    "prompt_render": V.sql(V.NODES, """SELECT seq, CAST(preorder AS INTEGER) AS preorder, sha256(CASE WHEN type = 'Word' THEN 'task: write a note level: word word: ' || content || ' pos: ' || coalesce(nullif(trim(pos[1]), ''), 'UNKNOWN') || ' tag: ' || coalesce(nullif(trim(tag[1]), ''), 'UNKNOWN') || ' dep: ' || coalesce(nullif(trim(dep[1]), ''), 'UNKNOWN')
      ELSE 'task: write a note level: ' || lower(type) || ' text: ' || content || ' pos: ' || replace(array_to_string(pos, ', '), '|', ':') || ' dep: ' || replace(array_to_string(dep, ', '), '|', ':') || ' tam: ' || tam END) AS prompt_sha256 FROM nodes"""),
    "legacy_prompt_render": V.sql(V.NODES, """SELECT n.seq, CAST(n.preorder AS INTEGER) AS preorder, sha256('pos: ' || array_to_string(n.pos, ', ') || ' dep: ' || array_to_string(n.dep, ', ') || ' sentence: ' || s.content || ' chunk: ' || n.content) AS prompt_sha256
      FROM nodes n JOIN nodes s ON n.seq = s.seq AND s.type = 'Sentence' WHERE n.type = 'Phrase'"""),
    "dedup_exact_pairs": V.sql(_DEDUP, "SELECT seq, input, target FROM dedup"),
    "cap_per_target": V.sql(_CAP, "SELECT seq, target, CAST(k AS INTEGER) AS rank FROM caps WHERE k <= 20"),
    "dedup_cap_report": V.sql(_CAP, """, kept AS (SELECT input, target FROM caps WHERE k <= 20), c AS (SELECT count(*) AS total, (SELECT count(*) FROM kept) AS kept FROM examples), x AS (SELECT count(*) AS n FROM examples JOIN kept USING (input, target))
      SELECT total, kept, x.n - kept AS exact_duplicates, total - x.n AS capped FROM c, x"""),
    "balance_level_tam": V.sql(V.EXAMPLES, """, r AS (SELECT *, row_number() OVER (PARTITION BY level, tam_bucket ORDER BY md5('42|' || seq)) AS k, count(*) OVER (PARTITION BY level, tam_bucket) AS n FROM examples), m AS (SELECT level, min(n) AS least FROM r GROUP BY level)
      SELECT seq, level, tam_bucket FROM r JOIN m USING (level) WHERE k <= least"""),
    "split_train_dev_test": V.sql(V.EXAMPLES, """, r AS (SELECT seq, row_number() OVER (ORDER BY md5('42|' || seq)) AS k, count(*) OVER () AS n FROM examples)
      SELECT seq, CASE WHEN k <= floor(n * 0.1::DOUBLE) THEN 'test' WHEN k <= floor(n * 0.1::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM r"""),
    "split_sizes": V.sql(_DEDUP, """, c AS (SELECT count(*) AS n FROM dedup), s AS (SELECT n, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS t FROM c)
      SELECT 'test' AS split, t AS n FROM s UNION ALL SELECT 'dev', t FROM s UNION ALL SELECT 'train', n - 2 * t FROM s"""),
    "bootstrap_per_stratum": V.sql(V.EXAMPLES, "SELECT seq, level, target FROM (SELECT *, row_number() OVER (PARTITION BY level, target ORDER BY md5('42|' || seq)) AS r FROM examples) WHERE r <= 100"),
    "bootstrap_splits": V.sql(V.EXAMPLES, """, r AS (SELECT level, target, md5('42|' || seq) AS h, row_number() OVER (PARTITION BY level, target ORDER BY md5('42|' || seq)) AS r FROM examples)
      SELECT level, target, CASE WHEN r <= 1200 THEN 'train' WHEN r <= 1400 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, min(h) AS least FROM r WHERE r <= 1600 GROUP BY 1, 2, 3"""),
    "count_by_level": V.sql(V.EXAMPLES, "SELECT level, count(*) AS n FROM examples GROUP BY level"),
    "level_tam_matrix": V.sql(V.EXAMPLES, "SELECT level, tam_bucket, count(*) AS n FROM examples GROUP BY ALL"),
    "level_tam_cube": V.sql(V.EXAMPLES, "SELECT level, tam_bucket, count(*) AS n, CAST(grouping_id(level, tam_bucket) AS BIGINT) AS g FROM examples GROUP BY CUBE (level, tam_bucket)"),
    "target_stats": V.sql(V.EXAMPLES, "SELECT count(*) AS total, count(DISTINCT lower(target)) AS unique_targets, round(1 - count(DISTINCT lower(target)) / count(*), 6) AS duplicate_ratio FROM examples"),
    "target_topk": V.sql(V.EXAMPLES, "SELECT lower(target) AS target, count(*) AS count FROM examples GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 15"),
    "quality_gates": V.sql(V.EXAMPLES, """, g AS (SELECT target, count(*) AS n FROM examples GROUP BY target)
      SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique, count(*) FILTER (target <> 'none') AS active, count(*) < 20 AS fails_unique, max(n) / sum(n) > 0.3 AS fails_top1, count(*) FILTER (target <> 'none') < 15 AS fails_active, CAST(round(max(n) / sum(n), 6) AS DOUBLE) AS top1_share FROM g""").replace("AS unique,", 'AS "unique",'),
    "feedback_mix_weighted": V.sql(V.EXAMPLES, "SELECT level, target, count(*) * CASE WHEN level = 'Word' THEN 3 ELSE 1 END AS n FROM examples GROUP BY level, target"),
}
