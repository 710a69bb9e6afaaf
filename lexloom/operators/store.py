"""Stores: reviews and edits, upserts and replacements, accounts, documents, files, jobs, queues, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..plans import views as V

#: Fields open to review, licences, and the licences that a source allows.
REVIEW_FIELDS = ("notes", "translation", "phonetic", "synonyms", "cefr_level", "tense", "aspect", "mood", "voice", "finiteness", "grammatical_role", "tam_construction", "part_of_speech", "dep_label", "features")
CEFR_LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
ATTRIBUTED_LICENCES = ("public_domain", "cc_by", "cc_by_sa", "mit", "apache_2_0")
SOURCE_LICENCES = {
    "manual_review": ("internal_review", "project_owned"),
    "trusted_corpus": ("public_domain", "cc_by", "cc_by_sa", "mit", "apache_2_0"),
    "public_reference": ("public_domain", "cc_by", "cc_by_sa"),
    "project_asset": ("project_owned", "mit", "apache_2_0"),
}
#: Statuses of jobs by kind of event; those that may be retried or resumed.
STATUS = {"view": "queued", "click": "processing", "purchase": "completed", "error": "failed", "signup": "canceled"}
RETRYABLE, RESUMABLE = ("failed", "error", "canceled"), ("queued", "processing")

_SOURCES = ("manual_review", "trusted_corpus", "public_reference", "project_asset", "unknown")
_LICENCES = ("internal_review", "cc_by", "mit", "project_owned", "apache_2_0", "gpl", "public_domain")
_PATHS = ("notes[0].text", "cefr_level", "translation.text", "node_id", "", "features.tense", "cefr_level", "synonyms[2]")
_VALUES = ("B1", "b2", "A2", "Z9", "C1")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    reviewer = F.when(i % 7 == 0, "  ").otherwise(F.concat(F.lit("reviewer_"), (i % 4).cast("string")))
    url = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("https://example.org/"), i.cast("string")))
    return c.select(i.alias("id"), F.concat(F.lit("s"), (i % 50).cast("string")).alias("sentence_key"), reviewer.alias("reviewed_by"), _pick(_SOURCES, i).alias("source"), _pick(_LICENCES, i).alias("licence"), url.alias("source_url"))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("edit_id"), F.col("conv_id").alias("review_id"), F.concat(F.lit("n"), (F.col("turn") % 3).cast("string")).alias("node_id"), _pick(_PATHS, k).alias("field_path"), _pick(_VALUES, k).alias("after_value"))


def joined_edits(reviews_: DataFrame, edits_: DataFrame) -> DataFrame:
    return reviews_.join(edits_, F.col("id") == F.col("review_id"))


def review_edit_join(spark: SparkSession, sf: str) -> DataFrame:
    j = joined_edits(reviews(spark, sf), edits(spark, sf))
    return j.where("sentence_key = 's7'").select("id", "edit_id", "node_id", "field_path", "after_value").orderBy("id", "edit_id")


def review_export(spark: SparkSession, sf: str) -> DataFrame:
    """The newest feedback rows of one reviewer, by edit id; the limit is the export's own."""
    j = joined_edits(reviews(spark, sf), edits(spark, sf)).where("reviewed_by = 'reviewer_1'")
    return j.select("edit_id", "sentence_key", "node_id", "field_path", "after_value").orderBy("edit_id").limit(100)


def review_row_ok() -> Column:
    """Whether a feedback row may leave: field, reviewer, source, licence, address, level."""
    root = F.regexp_extract(F.trim("field_path"), r"^([A-Za-z_]\w*)", 1)
    licence = F.lower(F.trim("licence"))
    allowed = F.lit(False)
    for source, licences in SOURCE_LICENCES.items():
        allowed = allowed | ((F.trim("source") == source) & licence.isin(*licences))
    attributed = ~licence.isin(*ATTRIBUTED_LICENCES) | F.trim("source_url").rlike("^https?://")
    level = (root != "cefr_level") | F.col("after_value").isin(*CEFR_LEVELS)
    return root.isin(*REVIEW_FIELDS) & (F.trim("reviewed_by") != "") & allowed & attributed & level


def hil_quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that pass, the first of each (sentence, node, path, value)."""
    ok = joined_edits(reviews(spark, sf), edits(spark, sf)).where(review_row_ok())
    first = F.min("edit_id").alias("edit_id")
    return ok.groupBy("sentence_key", "node_id", "field_path", "after_value").agg(first)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate that combines in each task, whatever a key's share of the rows."""
    rest = [c for c in df.columns if c not in keys]
    one = F.max_by(F.struct(*rest), F.struct(*order)).alias("_one")
    return df.groupBy(*keys).agg(one).select(*keys, *[F.col("_one")[c].alias(c) for c in rest])


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """New state: of each key the row of the highest version; created stays the first version's.  One aggregate."""
    every = state.unionByName(batch)
    rest = [c for c in every.columns if c not in keys]
    g = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_one"), F.min(version).alias("created"))
    return g.select(*keys, *[F.col("_one")[c].alias(c) for c in rest], "created")


def upsert_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).select(T.sentence_hash("text", F.lit(0)).alias("sentence_key"), F.concat("lang", F.lit("->en")).alias("language_pair"), F.col("seq").alias("version"))
    return upsert(s.where("version % 2 = 0"), s.where("version % 2 = 1"), ["sentence_key"], "version")


def replace_partition(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """state without the batch's keys, and the batch."""
    return state.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def replace_document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf).select("doc_id", "sent_idx", F.length("text").alias("n"))
    new = s.where("doc_id % 4 = 0 and sent_idx % 2 = 0").withColumn("n", -F.col("n"))
    return replace_partition(s, new, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum("n").alias("chars"))


def count_language_pair(spark: SparkSession, sf: str) -> DataFrame:
    return V.sentences(spark, sf).groupBy(F.concat("lang", F.lit("->en")).alias("language_pair")).agg(F.count(F.lit(1)).alias("n"))


def sentence_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.sentences(spark, sf).select("doc_id", "sent_idx", T.sentence_hash("text", "sent_idx").alias("sentence_hash"))


def sentence_key_hash(spark: SparkSession, sf: str) -> DataFrame:
    key = T.sentence_key(F.col("text"), F.col("lang"), F.lit("EN"), F.lit('{"mode":"batch"}'))
    return V.sentences(spark, sf).select("seq", key.alias("sentence_key"))


def phone_e164(c: Column) -> Column:
    """+ and 10 to 15 digits, or null: the reference raises, a column yields null."""
    clean = F.regexp_replace(F.trim(c), r"[^\d+]", "")
    digits = F.regexp_replace(clean, r"^\+", "")
    return F.when(digits.rlike(r"^\d{10,15}$"), F.concat(F.lit("+"), digits))


def phone_normalize_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "customer").select("c_custkey")
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "+").otherwise(""), F.lit("49 ("), (F.col("c_custkey") % 900 + 100).cast("string"), F.lit(") "), (F.col("c_custkey") * 7919).cast("string"))
    phone = phone_e164(raw)
    return c.select("c_custkey", phone.alias("phone"), F.sha2(F.concat(F.lit("salt:"), phone), 256).alias("phone_hash"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = V.read(spark, sf, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def jobs_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(jobs(spark, sf), ["file_id"], ["ts", "id"]).select("file_id", "id", "status")


def jobs_resumable(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 newest jobs to resume."""
    return jobs_latest(spark, sf).where(F.col("status").isin(*RESUMABLE)).orderBy(F.desc("id")).limit(50)


def jobs_retry(spark: SparkSession, sf: str) -> DataFrame:
    last = jobs_latest(spark, sf)
    return last.withColumn("after", F.when(F.col("status").isin(*RETRYABLE), "queued").otherwise(F.col("status"))).groupBy("status", "after").agg(F.count(F.lit(1)).alias("n"))


def sync_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by kind and state: a large file is a reference, a small one misses its content."""
    f = files(spark, sf)
    kind = F.when(F.col("size_bytes") > 250 * 1024 * 1024, "large_media_reference").otherwise("missing_content")
    state = F.when(F.col("id") % 5 == 0, "failed").when(F.col("id") % 5 == 1, "sent").otherwise("queued")
    return f.groupBy(kind.alias("kind"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    o = V.read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.floor(F.col("o_totalprice") * 2000).alias("size_bytes"), (F.col("o_orderkey") % 1800 + 1).alias("duration"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    li = V.read(spark, sf, "lineitem").where("l_linenumber <= 2")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("processing").alias("status"))


def media_files_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Files with their completed documents: the predicate belongs to the join, so files without one stay; several documents fan out."""
    done = documents(spark, sf).where("status = 'completed'").select("file_id", F.col("id").alias("document_id"))
    j = files(spark, sf).join(done, F.col("id") == F.col("file_id"), "left")
    return j.select("id", "project_id", "document_id", F.col("document_id").isNotNull().alias("analyzed"))


def project_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    done = documents(spark, sf).where("status = 'completed'").select("file_id").distinct()
    f = files(spark, sf).join(done.withColumn("done", F.lit(True)), F.col("id") == F.col("file_id"), "left")
    per = f.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("done")).alias("analyzed"))
    p = V.read(spark, sf, "customer").select("c_custkey")
    return p.join(per, F.col("c_custkey") == F.col("project_id"), "left").select("c_custkey", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("analyzed", F.lit(0)).alias("analyzed"))


def document_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with its five child figures (sentences, contracts, links, version and length of its text) and its file's latest job; children are counted before the join."""
    d = V.read(spark, sf, "documents").select("doc_id", "n_chars")
    s = V.sentences(spark, sf)
    counts = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.col("seq") % 11 != 5).alias("contracts"), F.count_if(F.col("seq") % 11 != 0).alias("linked"), F.sum(F.length("text")).alias("text_length"), (F.max("sent_idx") + 1).cast("long").alias("version"))
    last = jobs_latest(spark, sf).select("file_id", F.col("status").alias("job_status"))
    j = d.join(counts, "doc_id", "left").join(last, (F.col("doc_id") % 100) == F.col("file_id"), "left")
    return j.select("doc_id", "n_chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sentences", "contracts", "linked", "text_length", "version")], F.coalesce("job_status", F.lit("none")).alias("job_status"))


def media_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = V.sentences(spark, sf)
    return s.select(F.col("doc_id").alias("document_id"), "sent_idx", "seq", "text", T.sentence_hash("text", "sent_idx").alias("hash"))


def visualizer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Media sentences that have a link whose contract exists."""
    m = media_sentences(spark, sf)
    link = m.where("seq % 11 <> 3").select("document_id", "sent_idx", "hash")
    contract = m.where("seq % 11 <> 5").select("document_id", "hash", F.length("text").alias("payload"))
    j = m.join(link, ["document_id", "sent_idx", "hash"]).join(contract, ["document_id", "hash"])
    return j.select("document_id", "sent_idx", "payload")


def visualizer_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Display keys: a text that repeats in its document gets its number."""
    m = media_sentences(spark, sf)
    n = F.row_number().over(W.Window.partitionBy("document_id", "text").orderBy("sent_idx"))
    return m.select("document_id", "sent_idx", F.when(n == 1, F.col("text")).otherwise(F.concat("text", F.lit(" #"), n.cast("string"))).alias("display_key"))


def contract_hash_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A contract sentence's hash: its own, else by index, else by the n-th occurrence of its text, else made from it."""
    m = media_sentences(spark, sf)
    nth = F.row_number().over(W.Window.partitionBy("document_id", "text").orderBy("sent_idx"))
    k = F.col("seq") % 4
    c = m.select("document_id", "seq", "text", nth.alias("nth"), F.when(k == 0, F.col("hash")).alias("own"), F.when(k == 1, F.col("sent_idx")).alias("at"))
    media = m.where("seq % 6 <> 2").select("document_id", "sent_idx", "hash", "text", nth.alias("nth"))
    by_index = media.select("document_id", F.col("sent_idx").alias("at"), F.col("hash").alias("h_index"))
    by_text = media.select("document_id", "text", "nth", F.col("hash").alias("h_text"))
    j = c.join(by_index, ["document_id", "at"], "left").join(by_text, ["document_id", "text", "nth"], "left")
    made = T.sentence_hash("text", F.lit(-1))
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("h_index").isNotNull(), "index").when(F.col("h_text").isNotNull(), "text").otherwise("made")
    return j.select("seq", F.coalesce("own", "h_index", "h_text", made).alias("hash"), how.alias("how"))


def file_settings_join(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    settings = f.where("id % 3 = 0").select(F.concat(F.lit("media_file_settings:"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("voice"), (F.col("id") % 4).cast("string")).alias("voice"))
    j = f.withColumn("key", F.concat(F.lit("media_file_settings:"), F.col("id").cast("string"))).join(settings, "key", "left")
    return j.select("id", F.coalesce("voice", F.lit("default")).alias("voice"))


def orphan_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose parent is missing, by relation."""
    f = files(spark, sf).where("id % 97 <> 0")
    d = documents(spark, sf).join(f.select(F.col("id").alias("file_id")), "file_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("document_without_file").alias("relation"), "n")
    p = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    g = files(spark, sf).join(p, "project_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("file_without_project").alias("relation"), "n")
    return d.union(g)


def expired(files: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Files (ts, ...) with `gone`: older than their time; an age of exactly the limit stays."""
    return files.withColumn("gone", (F.unix_timestamp(now) - F.unix_timestamp("ts")) > ttl_hours * 3600)


def _temporary(spark: SparkSession, sf: str) -> DataFrame:
    e = V.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("bytes"))
    return expired(e, F.lit("2024-02-01 00:00:00").cast("timestamp"))


def ttl_cleanup_report(spark: SparkSession, sf: str) -> DataFrame:
    """Files older than a day at a fixed hour, counted and summed."""
    gone = F.col("gone")
    return _temporary(spark, sf).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("freed"))


def ttl_rows_to_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The files that the clean-up deletes: a plan; nothing is deleted here."""
    return _temporary(spark, sf).where("gone").select("event_id", "bytes")


QUERIES = {f.__name__: f for f in (
    review_edit_join, review_export, hil_quality_gates, upsert_sentences, replace_document_sentences, count_language_pair, sentence_hash, sentence_key_hash, phone_normalize_hash, jobs_latest, jobs_resumable,
    jobs_retry, sync_queue, media_files_analysis, project_file_counts, document_status, visualizer_rows, visualizer_keys, contract_hash_resolution, file_settings_join, orphan_checks, ttl_cleanup_report, ttl_rows_to_delete,
)}

_arr = lambda xs: "[" + V.sql_list(xs) + "]"
_REVIEWS = f"""
reviews AS (SELECT conv_id AS id, 's' || conv_id % 50 AS sentence_key, CASE WHEN conv_id % 7 = 0 THEN '  ' ELSE 'reviewer_' || conv_id % 4 END AS reviewed_by, ({_arr(_SOURCES)})[conv_id % 5 + 1] AS source,
  ({_arr(_LICENCES)})[conv_id % 7 + 1] AS licence, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'https://example.org/' || conv_id END AS source_url FROM (SELECT DISTINCT conv_id FROM conversations)),
edits AS (SELECT conv_id * 1000 + turn AS edit_id, conv_id AS review_id, 'n' || turn % 3 AS node_id, ({_arr(_PATHS)})[(conv_id * 3 + turn) % 8 + 1] AS field_path, ({_arr(_VALUES)})[(conv_id * 3 + turn) % 5 + 1] AS after_value FROM conversations),
j AS (SELECT * FROM reviews JOIN edits ON id = review_id)"""
_ALLOWED = " OR ".join(f"(source = '{s}' AND licence IN ({V.sql_list(x)}))" for s, x in SOURCE_LICENCES.items())
_JOBS = """
jobs AS (SELECT event_id AS id, user_id AS file_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'canceled' END AS status, ts FROM events),
latest AS (SELECT file_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, id DESC) AS r FROM jobs) WHERE r = 1)"""
_FILES = """
files AS (SELECT o_orderkey AS id, o_custkey AS project_id, CAST(floor(o_totalprice * 2000) AS BIGINT) AS size_bytes, o_orderkey % 1800 + 1 AS duration FROM orders),
docs AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file_id, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'processing' END AS status FROM lineitem WHERE l_linenumber <= 2)"""
_MEDIA = V.SENTENCES + ", media AS (SELECT doc_id AS document_id, sent_idx, seq, text, sha256(lower(text) || '|' || sent_idx) AS hash FROM sentences)"

ORACLES = {
    "review_edit_join": V.sql(_REVIEWS, "SELECT id, edit_id, node_id, field_path, after_value FROM j WHERE sentence_key = 's7'"),
    "review_export": V.sql(_REVIEWS, "SELECT edit_id, sentence_key, node_id, field_path, after_value FROM j WHERE reviewed_by = 'reviewer_1' ORDER BY edit_id LIMIT 100"),
    "hil_quality_gates": V.sql(_REVIEWS, rf"""SELECT sentence_key, node_id, field_path, after_value, min(edit_id) AS edit_id FROM j WHERE regexp_extract(trim(field_path), '^([A-Za-z_]\w*)', 1) IN ({V.sql_list(REVIEW_FIELDS)})
      AND trim(reviewed_by) <> '' AND ({_ALLOWED}) AND (licence NOT IN ({V.sql_list(ATTRIBUTED_LICENCES)}) OR source_url LIKE 'http://%' OR source_url LIKE 'https://%')
      AND (regexp_extract(trim(field_path), '^([A-Za-z_]\w*)', 1) <> 'cefr_level' OR after_value IN ({V.sql_list(CEFR_LEVELS)})) GROUP BY ALL"""),
    "upsert_sentences": V.sql(V.SENTENCES, """, v AS (SELECT sha256(lower(text) || '|0') AS sentence_key, lang || '->en' AS language_pair, seq AS version FROM sentences)
      SELECT sentence_key, arg_max(language_pair, version) AS language_pair, max(version) AS version, min(version) AS created FROM v GROUP BY sentence_key"""),
    "replace_document_sentences": V.sql(V.SENTENCES, """SELECT doc_id, count(*) AS sentences, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN -length(text) ELSE length(text) END) AS BIGINT) AS chars FROM sentences
      WHERE doc_id % 4 <> 0 OR sent_idx % 2 = 0 GROUP BY doc_id"""),
    "count_language_pair": V.sql(V.SENTENCES, "SELECT lang || '->en' AS language_pair, count(*) AS n FROM sentences GROUP BY 1"),
    "sentence_hash": V.sql(V.SENTENCES, "SELECT doc_id, sent_idx, sha256(lower(text) || '|' || sent_idx) AS sentence_hash FROM sentences"),
    "sentence_key_hash": V.sql(V.SENTENCES, """SELECT seq, sha256('v1|' || text || '|' || lower(lang) || '|en|{"mode":"batch"}') AS sentence_key FROM sentences"""),
    "phone_normalize_hash": """WITH r AS (SELECT c_custkey, '49' || (c_custkey % 900 + 100) || (c_custkey * 7919) AS d FROM customer)
      SELECT c_custkey, CASE WHEN length(d) BETWEEN 10 AND 15 THEN '+' || d END AS phone, CASE WHEN length(d) BETWEEN 10 AND 15 THEN sha256('salt:+' || d) END AS phone_hash FROM r""",
    "jobs_latest": V.sql(_JOBS, "SELECT file_id, id, status FROM latest"),
    "jobs_resumable": V.sql(_JOBS, "SELECT file_id, id, status FROM latest WHERE status IN ('queued', 'processing') ORDER BY id DESC LIMIT 50"),
    "jobs_retry": V.sql(_JOBS, "SELECT status, CASE WHEN status IN ('failed', 'error', 'canceled') THEN 'queued' ELSE status END AS after, count(*) AS n FROM latest GROUP BY 1, 2").replace(" AS after,", ' AS "after",'),
    "sync_queue": V.sql(_FILES, "SELECT CASE WHEN size_bytes > 262144000 THEN 'large_media_reference' ELSE 'missing_content' END AS kind, CASE WHEN id % 5 = 0 THEN 'failed' WHEN id % 5 = 1 THEN 'sent' ELSE 'queued' END AS state, count(*) AS n FROM files GROUP BY 1, 2"),
    "media_files_analysis": V.sql(_FILES, "SELECT f.id, project_id, d.id AS document_id, d.id IS NOT NULL AS analyzed FROM files f LEFT JOIN docs d ON f.id = d.file_id AND d.status = 'completed'"),
    "project_file_counts": V.sql(_FILES, """SELECT c_custkey, count(f.id) AS total, count(*) FILTER (f.id IN (SELECT file_id FROM docs WHERE status = 'completed')) AS analyzed FROM customer LEFT JOIN files f ON c_custkey = project_id GROUP BY c_custkey"""),
    "document_status": V.sql(V.SENTENCES + "," + _JOBS, """SELECT d.doc_id, n_chars, (SELECT count(*) FROM sentences s WHERE s.doc_id = d.doc_id) AS sentences, (SELECT count(*) FROM sentences s WHERE s.doc_id = d.doc_id AND s.seq % 11 <> 5) AS contracts, (SELECT count(*) FROM sentences s WHERE s.doc_id = d.doc_id AND s.seq % 11 <> 0) AS linked,
      CAST(coalesce((SELECT sum(length(text)) FROM sentences s WHERE s.doc_id = d.doc_id), 0) AS BIGINT) AS text_length, CAST(coalesce((SELECT max(sent_idx) + 1 FROM sentences s WHERE s.doc_id = d.doc_id), 0) AS BIGINT) AS version, coalesce(status, 'none') AS job_status FROM documents d LEFT JOIN latest ON d.doc_id % 100 = file_id"""),
    "visualizer_rows": V.sql(_MEDIA, "SELECT m.document_id, m.sent_idx, CAST(length(c.text) AS INTEGER) AS payload FROM media m JOIN media l ON m.seq = l.seq AND l.seq % 11 <> 3 JOIN media c ON c.document_id = m.document_id AND c.hash = m.hash AND c.seq % 11 <> 5"),
    "visualizer_keys": V.sql(_MEDIA, "SELECT document_id, sent_idx, CASE WHEN n = 1 THEN text ELSE text || ' #' || n END AS display_key FROM (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY sent_idx) AS n FROM media)"),
    "contract_hash_resolution": V.sql(_MEDIA, """, c AS (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY sent_idx) AS nth FROM media), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY sent_idx) AS nth FROM media WHERE seq % 6 <> 2)
      SELECT c.seq, CASE WHEN c.seq % 4 = 0 THEN c.hash ELSE coalesce(i.hash, t.hash, sha256(lower(c.text) || '|-1')) END AS hash, CASE WHEN c.seq % 4 = 0 THEN 'own' WHEN i.hash IS NOT NULL THEN 'index' WHEN t.hash IS NOT NULL THEN 'text' ELSE 'made' END AS how
      FROM c LEFT JOIN k i ON c.document_id = i.document_id AND c.sent_idx = i.sent_idx AND c.seq % 4 = 1 LEFT JOIN k t ON c.document_id = t.document_id AND c.text = t.text AND c.nth = t.nth"""),
    "file_settings_join": V.sql(_FILES, "SELECT id, CASE WHEN id % 3 = 0 THEN 'voice' || id % 4 ELSE 'default' END AS voice FROM files"),
    "orphan_checks": V.sql(_FILES, """SELECT 'document_without_file' AS relation, count(*) AS n FROM docs WHERE file_id NOT IN (SELECT id FROM files WHERE id % 97 <> 0)
      UNION ALL SELECT 'file_without_project', count(*) FROM files WHERE project_id NOT IN (SELECT c_custkey FROM customer)"""),
    "ttl_rows_to_delete": "SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events WHERE floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(CAST(ts AS TIMESTAMP)))) > 86400",
    "ttl_cleanup_report": """SELECT count(*) AS scanned, count(*) FILTER (g) AS deleted, CAST(coalesce(sum(CASE WHEN g THEN b END), 0) AS BIGINT) AS freed FROM
      (SELECT floor(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(CAST(ts AS TIMESTAMP)))) > 86400 AS g, floor(value * 100) AS b FROM events)""",
}
