"""Corpus ingestion: ids, normalisation, eligibility, deduplication, quotas, levels, quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..functions.providers import nfc
from ..plans import views as V

LEAST_CHARS, MOST_CHARS = 12, 260


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = V.read(spark, sf, "documents")
    rows = d.select("doc_id", T.squeeze("text").alias("text")).where("text <> ''")
    return rows.select(F.format_string("sent_%07d", "doc_id").alias("id"), "text", F.lit("unknown").alias("cefr_level"))


def scan_jsonl_default_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without an id take the source's name and the line's index; blank lines take an index too."""
    d = V.read(spark, sf, "documents").select("doc_id", "source", "text")
    # The scan itself is sources.jsonl(); here each source's lines are its documents in order.
    line = F.row_number().over(W.Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = d.withColumn("line", line).where(F.trim("text") != "")
    own = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("own_"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.coalesce(own, F.format_string("%s_%07d", "source", "line")).alias("id"))


def html_strip_pages(spark: SparkSession, sf: str) -> DataFrame:
    return V.read(spark, sf, "pages").select("page_id", T.strip_html("html").alias("text"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf)
    return s.where(T.looks_like_sentence("text")).select("doc_id", "sent_idx", "text")


def length_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.length("text").between(LEAST_CHARS, MOST_CHARS)
    return V.sentences(spark, sf).groupBy("source").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("dropped"))


def first_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key in order; a partial aggregate, so copies meet as one row per task."""
    rest = [c for c in df.columns if c not in keys]
    one = F.min_by(F.struct(*rest), F.col(order)).alias("_one")
    return df.groupBy(*keys).agg(one).select(*keys, *[F.col("_one")[c].alias(c) for c in rest])


def corpus_dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).withColumn("key", T.norm_key("text"))
    kept = first_by(s.select("key", "seq", "source"), ["key"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def ingest(sentences: DataFrame, sources: list[str], quota: int) -> DataFrame:
    """Source by source: eligible rows, the first of each key not kept from earlier sources, up to the quota; one count row per source.

    The fold is over the few sources only; each step is distributed, reads its own source's rows, and stores the keys it keeps.
    A quota of zero or less still keeps one row.
    """
    most = max(quota, 1)
    ok = F.length("text").between(LEAST_CHARS, MOST_CHARS)
    keyed = V.stored(sentences.where(F.col("source").isin(*sources)).select("source", "seq", ok.alias("ok"), F.when(ok, T.norm_key("text")).alias("key")), "source")
    kept, out = None, None
    for name in sources:
        rows = keyed.where(F.col("source") == name)
        eligible = rows.where("ok").select("seq", "key")
        fresh = first_by(eligible if kept is None else eligible.join(kept, "key", "left_anti"), ["key"])
        # A bounded top-k: the quota is a limit that the feature asks for.
        taken = V.stored(fresh.select("seq", "key").orderBy("seq").limit(most))
        stop = taken.agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("kept"))
        read = rows.crossJoin(F.broadcast(stop)).where((F.col("kept") < most) | (F.col("seq") <= F.col("last")))
        counts = read.agg(F.count(F.lit(1)).alias("read_rows"), F.count_if(~F.col("ok")).alias("length_dropped"), F.coalesce(F.max("kept"), F.lit(0)).alias("kept"))
        counts = counts.select(F.lit(name).alias("source"), "read_rows", "kept", "length_dropped", (F.col("read_rows") - F.col("kept") - F.col("length_dropped")).alias("duplicates"))
        out = counts if out is None else out.unionByName(counts)
        kept = taken.select("key") if kept is None else kept.union(taken.select("key"))
    return out


def corpus_quota_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each source on its own (no keys seen across sources), quota 50: SQL can express that."""
    s = V.sentences(spark, sf)
    ok = s.where(F.length("text").between(LEAST_CHARS, MOST_CHARS)).select("source", T.norm_key("text").alias("key"), "seq")
    fresh = first_by(ok, ["source", "key"])
    # Only ranks up to the quota are kept, which Spark limits within each task before the shuffle.
    ranked = fresh.withColumn("rank", F.row_number().over(W.Window.partitionBy("source").orderBy("seq"))).where("rank <= 50")
    return ranked.select("source", "rank", "seq")


def corpus_fold_across_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All sources in the order of their names, quota 50."""
    names = [r["source"] for r in V.read(spark, sf, "documents").select("source").where("source is not null").distinct().orderBy("source").collect()]
    return ingest(V.sentences(spark, sf), names, 50)


def source_contribution_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = V.read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("n"), "source")))  # one row per source


def ingestion_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).select("source", T.norm_key("text").alias("key"), "doc_id")
    whole = s.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("key").alias("unique"), F.count_if(F.col("doc_id") % 5 != 0).alias("licensed")
    )
    total, unique = F.col("total"), F.col("unique")
    return whole.select(
        "total", (total - unique).alias("duplicates"),
        F.round(F.when(total > 0, (total - unique) / total).otherwise(0.0), 6).alias("duplicate_ratio"),
        F.round(F.when(total > 0, F.col("licensed") / total).otherwise(0.0), 6).alias("licence_coverage"),
    )


def level_records_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Level records: dependency only for words; attribution defaults to required."""
    n = V.nodes(spark, sf)
    dep = F.when(F.col("type") == "Word", F.get("dep", F.lit(0)))
    return n.groupBy("type", dep.alias("dep_label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


SENTENCE_QUOTA, PHRASE_QUOTA, WORD_QUOTA = 100, 300, 600


def level_quota_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Per level the first nodes in document order, up to the level's quota; no document after the one that fills the sentences' quota is read."""
    n = V.nodes(spark, sf).select("doc_id", "type", "seq", "preorder")
    # A bounded top-k: the quota is the feature's.
    full = n.where("type = 'Sentence'").select("doc_id", "seq").orderBy("seq").limit(SENTENCE_QUOTA).agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_last"))
    read = n.crossJoin(F.broadcast(full)).where((F.col("_n") < SENTENCE_QUOTA) | (F.col("doc_id") <= F.col("_last")))
    quota = F.when(F.col("type") == "Sentence", SENTENCE_QUOTA).when(F.col("type") == "Phrase", PHRASE_QUOTA).otherwise(WORD_QUOTA)
    # Rank up to the largest quota only: a group limit within tasks, then the level's own.
    ranked = read.select("type", "seq", "preorder").withColumn("rank", F.row_number().over(W.Window.partitionBy("type").orderBy("seq", "preorder"))).where(F.col("rank") <= max(SENTENCE_QUOTA, PHRASE_QUOTA, WORD_QUOTA))
    return ranked.where(F.col("rank") <= quota)


_RECORD = """type || '|' || content || '|' || sentence || '|' || source || '|' || url || '|' || licence || '|' || CASE WHEN coalesce(attribution, true) THEN 'attributed' ELSE 'free' END || '|' || CASE type WHEN 'Word' THEN word_dep || '|' || word_pos ELSE '-' END"""
_PROVENANCE = {"url": "'https://example.org/' || source", "licence": "CASE doc_id % 3 WHEN 0 THEN 'cc_by' WHEN 1 THEN 'mit' ELSE '' END", "attribution": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END"}


def level_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the three levels with their provenance; dependency and class only for words; attribution is required unless a source says otherwise."""
    d = V.read(spark, sf, "documents").select("doc_id", "source")
    n = V.nodes(spark, sf).select("doc_id", "type", "content", "sentence", F.col("dep")[0].alias("word_dep"), F.col("pos")[0].alias("word_pos")).join(d, "doc_id")
    for name, e in _PROVENANCE.items():
        n = n.withColumn(name, F.expr(e))
    return n.groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2(F.expr(_RECORD), 256)).alias("least"))


def ingestion_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """The report's tables: rows by source, and the 20 most frequent classes, dependencies and buckets: the report's own limit."""
    s = V.sentences(spark, sf).select(F.lit("source").alias("kind"), F.col("source").alias("key"))
    t = V.tokens(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("pos", "dep")])))
    n = V.nodes(spark, sf).select(F.lit("tam").alias("kind"), F.col("tam").alias("key"))
    g = s.unionByName(t).unionByName(n).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    # A few dozen rows.
    rank = F.row_number().over(W.Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    return g.withColumn("rank", rank).where((F.col("kind") == "source") | (F.col("rank") <= 20))


_SPELT = "CASE doc_id % 2 WHEN 0 THEN replace(text, 'é', 'é') ELSE text END"


def canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of texts in composed form with single spaces; only texts that are not ASCII go through Python."""
    d = V.read(spark, sf, "documents").select("doc_id", F.expr(_SPELT).alias("text"))
    plain = d.where(~F.coalesce(F.col("text").rlike(r"[^\x00-\x7f]"), F.lit(False)))
    other = d.where(F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("text", nfc("text"))
    return plain.unionByName(other).select("doc_id", F.sha2(T.squeeze("text"), 256).alias("text_sha256"))


def tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    d = V.read(spark, sf, "documents").select("doc_id", T.tokens("text").alias("ws"))
    return d.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"))


def token_topk(spark: SparkSession, sf: str) -> DataFrame:
    t = V.tokens(spark, sf)
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "i")).alias("first")).orderBy(F.desc("n"), "first").limit(20).select("w", "n")


QUERIES = {f.__name__: f for f in (
    text_normalize, scan_jsonl_default_ids, html_strip_pages, sentence_split, length_eligibility, corpus_dedup_first_wins, corpus_quota_per_source,
    corpus_fold_across_sources, source_contribution_rank, ingestion_quality_report, level_records_projection, level_quota_extract, level_records, ingestion_breakdown, canonical_text, tokenize_words, token_topk,
)}

_FOLD_SOURCES = tuple(sorted(f"src{i}" for i in range(20)))


def _sql_fold() -> str:
    steps, seen = [], "SELECT NULL AS key WHERE false"
    for k, name in enumerate(_FOLD_SOURCES):
        steps.append(f"t{k} AS MATERIALIZED (SELECT key, min(seq) AS seq FROM keyed WHERE source = '{name}' AND ok AND key NOT IN ({seen}) GROUP BY key ORDER BY min(seq) LIMIT 50)")
        seen = f"{seen} UNION ALL SELECT key FROM t{k}"
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) AS read_rows, coalesce(max(n), 0) AS kept, count(*) FILTER (NOT ok) AS length_dropped, count(*) - coalesce(max(n), 0) - count(*) FILTER (NOT ok) AS duplicates FROM keyed, (SELECT max(seq) AS last, count(*) AS n FROM t{k}) WHERE source = '{name}' AND (n < 50 OR seq <= last) HAVING count(*) > 0"
        for k, name in enumerate(_FOLD_SOURCES)
    )
    return V.sql(V.SENTENCES, f", keyed AS MATERIALIZED (SELECT source, seq, length(text) BETWEEN {LEAST_CHARS} AND {MOST_CHARS} AS ok, lower(text) AS key FROM sentences), " + ", ".join(steps) + " " + rows)


ORACLES = {
    "corpus_fold_across_sources": _sql_fold(),
    "text_normalize": r"SELECT printf('sent_%07d', doc_id) AS id, t AS text, 'unknown' AS cefr_level FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> ''",
    "scan_jsonl_default_ids": r"""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'own_' || doc_id ELSE source || '_' || printf('%07d', line) END AS id
      FROM (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line FROM documents) WHERE trim(text) <> ''""",
    "html_strip_pages": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "sentence_split": V.sql(V.SENTENCES, r"SELECT doc_id, sent_idx, text FROM sentences WHERE length(text) BETWEEN 8 AND 260 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 4"),
    "length_eligibility": V.sql(V.SENTENCES, "SELECT source, count(*) FILTER (length(text) BETWEEN 12 AND 260) AS eligible, count(*) FILTER (NOT length(text) BETWEEN 12 AND 260) AS dropped FROM sentences GROUP BY source"),
    "corpus_dedup_first_wins": V.sql(V.SENTENCES, """SELECT source, count(*) AS kept, min(seq) AS first_seq, max(seq) AS last_seq FROM
      (SELECT source, seq, row_number() OVER (PARTITION BY lower(text) ORDER BY seq) AS r FROM sentences) WHERE r = 1 GROUP BY source"""),
    "corpus_quota_per_source": V.sql(V.SENTENCES, """, fresh AS (SELECT source, seq, row_number() OVER (PARTITION BY source, lower(text) ORDER BY seq) AS r FROM sentences WHERE length(text) BETWEEN 12 AND 260)
      SELECT source, CAST(rank AS INTEGER) AS rank, seq FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS rank FROM fresh WHERE r = 1) WHERE rank <= 50"""),
    "source_contribution_rank": "SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS rank FROM documents GROUP BY source",
    "ingestion_quality_report": V.sql(V.SENTENCES, """SELECT count(*) AS total, count(*) - count(DISTINCT lower(text)) AS duplicates, round((count(*) - count(DISTINCT lower(text))) / count(*), 6) AS duplicate_ratio,
      round(count(*) FILTER (doc_id % 5 <> 0) / count(*), 6) AS licence_coverage FROM sentences"""),
    "level_records_projection": V.sql(V.NODES, "SELECT type, CASE WHEN type = 'Word' THEN dep[1] END AS dep_label, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM nodes GROUP BY 1, 2"),
    "level_quota_extract": V.sql(V.NODES, f""", q AS (SELECT doc_id FROM nodes WHERE type = 'Sentence' ORDER BY seq LIMIT {SENTENCE_QUOTA}), f AS (SELECT count(*) AS n, max(doc_id) AS last FROM q)
      SELECT type, seq, CAST(preorder AS INTEGER) AS preorder, CAST(rank AS INTEGER) AS rank FROM (SELECT type, seq, preorder, row_number() OVER (PARTITION BY type ORDER BY seq, preorder) AS rank FROM nodes, f WHERE n < {SENTENCE_QUOTA} OR doc_id <= last)
      WHERE rank <= CASE type WHEN 'Sentence' THEN {SENTENCE_QUOTA} WHEN 'Phrase' THEN {PHRASE_QUOTA} ELSE {WORD_QUOTA} END"""),
    "level_records": V.sql(V.NODES, ", sent AS MATERIALIZED (SELECT seq, content AS sentence FROM nodes WHERE type = 'Sentence'), r AS (SELECT n.doc_id, n.type, n.content, sentence, n.dep[1] AS word_dep, n.pos[1] AS word_pos, d.source, " + ", ".join(f"{e.replace('doc_id', 'd.doc_id').replace('source', 'd.source')} AS {k}" for k, e in _PROVENANCE.items()) + f" FROM nodes n JOIN sent USING (seq) JOIN documents d ON n.doc_id = d.doc_id) SELECT type, source, count(*) AS n, min(sha256({_RECORD})) AS least FROM r GROUP BY 1, 2"),
    "ingestion_breakdown": V.sql(V.NODES, """, k AS (SELECT 'source' AS kind, source AS key FROM sentences UNION ALL SELECT 'pos', pos FROM tokens UNION ALL SELECT 'dep', dep FROM tokens UNION ALL SELECT 'tam', tam FROM nodes), g AS (SELECT kind, key, count(*) AS n FROM k GROUP BY 1, 2)
      SELECT * FROM (SELECT kind, key, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS INTEGER) AS rank FROM g) WHERE kind = 'source' OR rank <= 20"""),
    "canonical_text": f"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize({_SPELT}), '\\s+', ' ', 'g'))) AS text_sha256 FROM documents",
    "tokenize_words": "SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS ws FROM documents)",
    "token_topk": V.sql(V.TOKENS, "SELECT w, n FROM (SELECT w, count(*) AS n, min(seq * 100000 + i) AS f FROM tokens GROUP BY w) ORDER BY n DESC, f LIMIT 20"),
}
