"""Media: routing, capabilities, licence gate, timelines, semantic units, subtitles, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans import views as V
from .store import files

MAX_MINUTES, MAX_LOCAL_MB = 15, 250


def media_route(spark: SparkSession, sf: str) -> DataFrame:
    """local within both limits, else reject; error without a positive duration and size; with the measured figures."""
    f = files(spark, sf)
    local = (F.col("duration") <= MAX_MINUTES * 60) & (F.col("size_bytes") <= MAX_LOCAL_MB * 1024 * 1024)
    route = F.when((F.col("duration") <= 0) | (F.col("size_bytes") <= 0), "error").when(local, "local").otherwise("reject")
    # Java's formatter rounds halves up, so they are rounded to even first: sizes in MB meet exact halves of a hundredth.
    two = lambda x: F.bround(x, 2)
    figures = F.format_string("duration=%.2fm (limit_local=15m), size=%.2fMB (limit_local=250MB)", two(F.col("duration") / 60.0), two(F.col("size_bytes") / (1024.0 * 1024)))
    return f.select("id", route.alias("route"), figures.alias("figures"))


def capability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every mode, phonetic policy and deployment with the capabilities that follow."""
    rows = [(m, p, d) for m in ("offline", "online") for p in ("enabled", "disabled", "backend_only") for d in ("local", "backend", "distributed")]
    m = spark.createDataFrame(rows, "mode string, policy string, deployment string").coalesce(1)
    online = F.col("mode") == "online"
    phonetic = online & (F.col("policy") != "disabled") & ((F.col("policy") != "backend_only") | (F.col("deployment") == "backend"))
    return m.withColumn("phonetic_enabled", phonetic).withColumn("db_persistence_enabled", online).withColumn("backend_jobs_enabled", F.lit(False))


def gate_code(policy: Column, mode: Column, approval: Column, listed: Column) -> Column:
    """First code that applies."""
    return (
        F.when(~policy.isin("enabled", "disabled", "backend_only"), "INVALID_POLICY").when(~listed, "INVENTORY_MISSING_PHONETIC").when(policy == "disabled", "PASS_DISABLED")
        .when((mode == "distributed") & ~approval, "LEGAL_APPROVAL_REQUIRED").when(mode == "distributed", "PASS_DISTRIBUTED_APPROVED").when((mode == "local") & (policy == "backend_only"), "POLICY_MODE_CONFLICT").otherwise("PASS")
    )


def license_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(p, m, a, i) for p in ("enabled", "disabled", "backend_only", "other") for m in ("local", "backend", "distributed") for a in (True, False) for i in (True, False)]
    df = spark.createDataFrame(rows, "policy string, mode string, approval boolean, listed boolean")
    code = gate_code(F.col("policy"), F.col("mode"), F.col("approval"), F.col("listed"))
    return df.withColumn("code", code).withColumn("ok", F.startswith(code, F.lit("PASS")))


def duration_seconds(text: Column) -> Column:
    """0.35 s a word and 0.8 s, between 1 s and 8 s."""
    return F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.regexp_count(text, F.lit(r"\w+")) * 0.35 + 0.8))


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds of each sentence of a document: it starts after all earlier ones and their pauses of 0.2 s."""
    s = V.sentences(spark, sf).withColumn("ms", F.round(duration_seconds(F.col("text")) * 1000).cast("long"))
    before = F.coalesce(F.sum(F.col("ms") + 200).over(W.Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("start_ms", before).withColumn("end_ms", F.col("start_ms") + F.col("ms"))


def timeline_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).select("doc_id", "sent_idx", "start_ms", "end_ms")


def semantic_units(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, words and symbols of a sentence, each an equal slice of its interval."""
    t = timeline(spark, sf)
    # ASCII classes: the regular expressions of both engines agree on them.
    units = F.regexp_extract_all("text", F.lit(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]"), 0)
    rows = t.select("doc_id", "sent_idx", "start_ms", "end_ms", units.alias("units")).select("doc_id", "sent_idx", "start_ms", "end_ms", F.size("units").alias("n"), F.posexplode("units").alias("k", "unit"))
    step = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)) / F.col("n")
    kind = F.when(F.col("unit").rlike("^[0-9]+$"), "number").when(F.col("unit").rlike("^[A-Za-z]+$"), "word").otherwise("symbol")
    rows = rows.select("doc_id", "sent_idx", (F.col("k") + 1).alias("id"), kind.alias("kind"), F.round((F.col("start_ms") + F.col("k") * step) / 1000, 3).alias("start"))
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.max("start").alias("last_start"))


def srt_time(ms: Column) -> Column:
    ms = F.greatest(F.lit(0), ms)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_render(spark: SparkSession, sf: str) -> DataFrame:
    """One subtitle file per document; cues without text are not numbered."""
    t = timeline(spark, sf).withColumn("body", F.when(F.col("sent_idx") % 10 != 9, F.trim("text")).otherwise("")).where("body <> ''")
    end = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(F.col("end_ms"))
    n = F.row_number().over(W.Window.partitionBy("doc_id").orderBy("sent_idx"))
    cue = F.concat(n.cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(end), F.lit("\n"), "body", F.lit("\n"))
    lines = t.select("doc_id", "sent_idx", cue.alias("cue"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "cue"))), lambda x: x["cue"]), "\n")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cues"), F.sha2(joined, 256).alias("srt_sha256"))


def interval_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Spans taken greedily by start where they don't overlap the last one taken; per document their number and the gaps' length."""
    s = V.sentences(spark, sf)
    spans = s.select("doc_id", (F.col("sent_idx") * 10).alias("a"), (F.col("sent_idx") * 10 + F.length("text") % 25 + 1).alias("b"))
    ordered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("xs"))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("taken"), F.lit(0).alias("gap"))
    fold = F.aggregate(
        "xs", zero,
        lambda acc, x: F.when(x["a"] >= acc["end"], F.struct(x["b"].alias("end"), (acc["taken"] + 1).alias("taken"), (acc["gap"] + F.greatest(F.lit(0), F.when(acc["end"] < 0, 0).otherwise(x["a"] - acc["end"]))).alias("gap"))).otherwise(acc),
    )
    return ordered.select("doc_id", fold.alias("f")).select("doc_id", "f.taken", "f.gap")


QUERIES = {f.__name__: f for f in (media_route, capability_matrix, license_gate, timeline_cumulative, semantic_units, srt_render, interval_cover)}

_TIMELINE = V.SENTENCES + r""",
durations AS (SELECT *, CAST(round(greatest(1.0::DOUBLE, least(8.0::DOUBLE, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) * 0.35::DOUBLE + 0.8::DOUBLE)) * 1000) AS BIGINT) AS ms FROM sentences),
timeline AS (SELECT *, CAST(coalesce(sum(ms + 200) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM durations)"""
_SRT = lambda c: f"printf('%02d:%02d:%02d,%03d', ({c}) // 3600000, ({c}) // 60000 % 60, ({c}) // 1000 % 60, ({c}) % 1000)"

ORACLES = {
    "media_route": """SELECT o_orderkey AS id, CASE WHEN d <= 900 AND s <= 262144000 THEN 'local' ELSE 'reject' END AS route, printf('duration=%.2fm (limit_local=15m), size=%.2fMB (limit_local=250MB)', d / 60.0::DOUBLE, s / 1048576.0::DOUBLE) AS figures
      FROM (SELECT o_orderkey, o_orderkey % 1800 + 1 AS d, CAST(floor(o_totalprice * 2000) AS BIGINT) AS s FROM orders)""",
    "capability_matrix": """SELECT mode, policy, deployment, mode = 'online' AND (policy = 'enabled' OR (policy = 'backend_only' AND deployment = 'backend')) AS phonetic_enabled, mode = 'online' AS db_persistence_enabled, false AS backend_jobs_enabled
      FROM (VALUES ('offline'), ('online')) a(mode), (VALUES ('enabled'), ('disabled'), ('backend_only')) b(policy), (VALUES ('local'), ('backend'), ('distributed')) c(deployment)""",
    "license_gate": """WITH r AS (SELECT policy, mode, approval, listed, CASE WHEN policy = 'other' THEN 'INVALID_POLICY' WHEN NOT listed THEN 'INVENTORY_MISSING_PHONETIC' WHEN policy = 'disabled' THEN 'PASS_DISABLED'
      WHEN mode = 'distributed' THEN CASE WHEN approval THEN 'PASS_DISTRIBUTED_APPROVED' ELSE 'LEGAL_APPROVAL_REQUIRED' END WHEN mode = 'local' AND policy = 'backend_only' THEN 'POLICY_MODE_CONFLICT' ELSE 'PASS' END AS code
      FROM (VALUES ('enabled'), ('disabled'), ('backend_only'), ('other')) a(policy), (VALUES ('local'), ('backend'), ('distributed')) b(mode), (VALUES (true), (false)) c(approval), (VALUES (true), (false)) d(listed))
      SELECT *, starts_with(code, 'PASS') AS ok FROM r""",
    "timeline_cumulative": V.sql(_TIMELINE, "SELECT doc_id, sent_idx, start_ms, start_ms + ms AS end_ms FROM timeline"),
    "semantic_units": V.sql(_TIMELINE, r""", u AS (SELECT doc_id, start_ms, ms, regexp_extract_all(text, '[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]') AS us FROM timeline), f AS (SELECT doc_id, start_ms, ms, len(us) AS n, unnest(us) AS unit, generate_subscripts(us, 1) AS id FROM u)
      SELECT doc_id, CASE WHEN regexp_full_match(unit, '[0-9]+') THEN 'number' WHEN regexp_full_match(unit, '[A-Za-z]+') THEN 'word' ELSE 'symbol' END AS kind, count(*) AS n, CAST(max(id) AS INTEGER) AS last_id, max(round((start_ms + (id - 1) * (greatest(ms, 1) / n)) / 1000, 3)) AS last_start FROM f GROUP BY 1, 2"""),
    "interval_cover": V.sql(V.SENTENCES, """, sp AS MATERIALIZED (SELECT doc_id, sent_idx * 10 AS a, CAST(sent_idx * 10 + length(text) % 25 + 1 AS INTEGER) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx * 10, sent_idx * 10 + length(text) % 25 + 1) AS k FROM sentences),
      RECURSIVE_WALK""").replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_WALK", "w AS (SELECT doc_id, k, b AS e, 1 AS taken, 0 AS gap FROM sp WHERE k = 1 UNION ALL SELECT w.doc_id, sp.k, CASE WHEN sp.a >= e THEN sp.b ELSE e END, CASE WHEN sp.a >= e THEN taken + 1 ELSE taken END, CASE WHEN sp.a >= e THEN gap + sp.a - e ELSE gap END FROM w JOIN sp ON sp.doc_id = w.doc_id AND sp.k = w.k + 1) SELECT doc_id, arg_max(taken, k) AS taken, arg_max(gap, k) AS gap FROM w GROUP BY doc_id"),
    "srt_render": V.sql(_TIMELINE, f""", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS n FROM (SELECT * FROM timeline WHERE sent_idx % 10 <> 9 AND trim(text) <> ''))
      SELECT doc_id, count(*) AS cues, sha256(string_agg(n || chr(10) || {_SRT('start_ms')} || ' --> ' || {_SRT('start_ms + ms')} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY sent_idx)) AS srt_sha256 FROM b GROUP BY doc_id"""),
}
