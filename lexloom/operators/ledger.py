"""Writes and views of the stores: persisted results, accounts, appended reviews and client rows, status updates, lists; viewers' texts; artifacts of documents; note reports and regression checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..plans import views as V
from . import annotate as A
from . import media, notes, store
from .store import joined_edits, latest

HASH_VERSION = "v1"
#: The columns of a stored sentence that an upsert takes from the newest run.
SENTENCE_COLUMNS = (
    "source_text", "source_lang", "target_lang", "hash_version", "last_run_id", "pipeline_context", "contract_payload", "language_pair", "tam_construction",
    "backoff_nodes_count", "backoff_leaf_nodes_count", "backoff_aggregate_nodes_count", "backoff_unique_spans_count",
)
#: The context that the fixtures are stored under.
CONTEXT = '{"mode":"batch"}'


def merged(state: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows by key as after upserts: the newest version's values, the first version as `created`, the last as `updated`; one aggregate."""
    every = state.unionByName(batch)
    rest = [c for c in every.columns if c not in keys]
    g = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_one"), F.min(version).alias("created"))
    return g.select(*keys, *[F.col("_one")[c].alias(c) for c in rest if c != version], "created", F.col("_one")[version].alias("updated"))


def stored_sentences(sentences: DataFrame, context: str = CONTEXT, target: str = "en") -> DataFrame:
    """Sentences (text, lang, run, seq, tam, n_words) as rows of the sentence store: key, its 13 other columns, version (run and place)."""
    text, context_ = T.squeeze("text"), F.lit(context)
    return sentences.select(
        T.sentence_key(F.col("text"), F.col("lang"), F.lit(target), context_).alias("sentence_key"), text.alias("source_text"), F.col("lang").alias("source_lang"), F.lit(target).alias("target_lang"), F.lit(HASH_VERSION).alias("hash_version"), F.col("run").alias("last_run_id"),
        context_.alias("pipeline_context"), F.to_json(F.struct(F.lit("Sentence").alias("type"), F.col("n_chars").alias("n"))).alias("contract_payload"), F.concat("lang", F.lit(f"->{target}")).alias("language_pair"), F.col("tam").alias("tam_construction"),
        (F.col("n_chars") % 7).alias("backoff_nodes_count"), (F.col("n_chars") % 5).alias("backoff_leaf_nodes_count"), F.greatest(F.lit(0), F.col("n_chars") % 7 - F.col("n_chars") % 5).alias("backoff_aggregate_nodes_count"), (F.col("n_chars") % 3).alias("backoff_unique_spans_count"),
        F.struct("run", "seq").alias("version"),
    )


_TAM = "CASE WHEN text LIKE '%the %' THEN 'none' END"


def persist_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over the sentences, the second over every third again: the store after both, the last run wins; digests stand for long texts."""
    s = V.sentences(spark, sf).select("seq", "text", "lang", F.length("text").alias("n_chars"), F.expr(_TAM).alias("tam"))
    first = stored_sentences(s.withColumn("run", F.lit("r1")))
    second = stored_sentences(s.where("seq % 3 = 0").withColumn("lang", F.col("lang")).withColumn("run", F.lit("r2")))
    m = merged(first, second, ["sentence_key"], "version")
    return m.select("sentence_key", F.sha2("source_text", 256).alias("source_sha256"), *[c for c in SENTENCE_COLUMNS if c != "source_text"], F.col("created.run").alias("created_run"), F.col("updated.run").alias("updated_run"))


def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Run metadata as upserted: sentences of a run, context, the last write's number."""
    s = V.sentences(spark, sf).select(F.concat(F.lit("run"), (F.col("doc_id") % 9).cast("string")).alias("run_id"), F.col("doc_id").alias("write"))
    n = s.groupBy("run_id", "write").agg(F.count(F.lit(1)).alias("sentence_count")).withColumn("pipeline_context", F.lit(CONTEXT)).withColumn("hash_version", F.lit(HASH_VERSION))
    return merged(n.where("write % 2 = 0"), n.where("write % 2 = 1"), ["run_id"], "write")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """phone_hash, id (the first row that named it), created and updated rows of backend accounts."""
    raw = F.concat(F.lit("+49 151 "), F.lpad((F.col("c_custkey") % 400).cast("string"), 7, "0"))
    c = V.read(spark, sf, "customer").select(F.sha2(F.concat(F.lit("salt:"), store.phone_e164(raw)), 256).alias("phone_hash"), F.col("c_custkey").alias("row"))
    return c.groupBy("phone_hash").agg(F.min("row").alias("id"), F.min("row").alias("created"), F.max("row").alias("updated"))


def account_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return accounts(spark, sf)


def account_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One account by its hash: a point lookup."""
    return accounts(spark, sf).where(F.col("phone_hash") == F.sha2(F.lit("salt:+491510000007"), 256)).limit(1)


def appended(state: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """state(id, ...) and batch with ids that go on from the last, in the batch's order.

    Ids are ranked within buckets of the order's hash and buckets added up, so no task sorts the batch.
    """
    last = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    ranked = V.by_rank(batch.withColumn("_h", F.lpad(F.hex(F.col(order)), 16, "0")), "_h", 13).crossJoin(F.broadcast(last))
    return state.unionByName(ranked.withColumn("id", F.col("rank") + F.col("_last")).select(*state.columns))


def review_append(spark: SparkSession, sf: str) -> DataFrame:
    """Edits appended to a store of the first conversations' edits: new ids go on in the order of their conversation and turn."""
    e = store.edits(spark, sf).select("edit_id", "review_id", "node_id", "field_path", F.to_json(F.struct(F.col("after_value").alias("v"))).alias("after_json"))
    state = e.where("review_id < 10").withColumn("id", F.col("edit_id")).select("id", "review_id", "node_id", "field_path", "after_json")
    return appended(state, e.where("review_id >= 10"), "edit_id")


def row_uuid(*parts: Column) -> Column:
    """A UUID made of a digest of the row's parts: the same row has the same id, whenever its task runs."""
    h = F.md5(F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,))]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def client_appends(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended to the client's tables, by table: how many, distinct ids, the least id."""
    f = store.files(spark, sf)
    rows = V.read(spark, sf, "customer").select(F.lit("projects").alias("table"), F.col("c_custkey").cast("string").alias("key"))
    rows = rows.unionByName(f.select(F.lit("media_files").alias("table"), F.col("id").cast("string").alias("key")))
    rows = rows.unionByName(V.read(spark, sf, "documents").select(F.lit("documents").alias("table"), F.col("doc_id").cast("string").alias("key")))
    rows = rows.unionByName(store.edits(spark, sf).select(F.lit("local_edits").alias("table"), F.col("edit_id").cast("string").alias("key")))
    rows = rows.unionByName(store.jobs(spark, sf).select(F.lit("backend_jobs").alias("table"), F.col("id").cast("string").alias("key")))
    rows = rows.unionByName(f.where("size_bytes > 262144000").select(F.lit("sync_requests").alias("table"), F.col("id").cast("string").alias("key")))
    ids = rows.withColumn("id", row_uuid(F.col("table"), F.col("key")))
    return ids.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"))


def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs after updates of their status by id: the last update holds, jobs without one keep theirs."""
    j = store.jobs(spark, sf).select("id", "status", F.col("id").alias("at"))
    updates = j.where("id % 4 = 0").select("id", F.when(F.col("status") == "queued", "processing").otherwise("completed").alias("status"), (F.col("id") + 1_000_000_000).alias("at"))
    m = merged(j, updates, ["id"], "at")
    return m.groupBy("status", (F.col("updated") > F.col("created")).alias("touched")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def selected_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Selections of a project that exists."""
    state = store.files(spark, sf).select((F.col("project_id") + F.col("id") % 3 * 100_000).alias("project_id")).distinct()
    projects = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    return state.join(projects, "project_id", "left_semi")


def recent_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Projects by their last file, newest first; ties by id."""
    last = store.files(spark, sf).groupBy("project_id").agg(F.max("id").alias("updated_at"), F.count(F.lit(1)).alias("files"))
    return last.orderBy(F.desc("updated_at"), "project_id")


_RAW = {"sentence_text": "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '' END", "text": "CASE turn % 4 WHEN 1 THEN ' ' || text || ' ' WHEN 3 THEN ' ' END", "text_eng": "CASE turn % 4 WHEN 2 THEN text WHEN 3 THEN '' END", "sentence_idx": "CASE turn % 3 WHEN 0 THEN turn * 10 END", "sentence_hash": "CASE turn % 5 WHEN 0 THEN 'given' END"}


def normalised_media(rows: DataFrame) -> DataFrame:
    """Media sentences (document_id, place, sentence_text, text, text_eng, sentence_idx, sentence_hash) with the first text that is not empty, the index or place, the hash given or made; rows without text go."""
    text = F.trim(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("sentence_text", "text", "text_eng")], F.lit("")))
    idx = F.coalesce("sentence_idx", "place")
    n = rows.select("document_id", idx.alias("sentence_idx"), text.alias("sentence_text"), "sentence_hash").where("sentence_text <> ''")
    return n.withColumn("sentence_hash", F.coalesce("sentence_hash", T.sentence_hash("sentence_text", "sentence_idx")))


def media_sentence_normalize(spark: SparkSession, sf: str) -> DataFrame:
    c = V.read(spark, sf, "conversations").selectExpr("conv_id AS document_id", "turn AS place", *[f"{e} AS {k}" for k, e in _RAW.items()])
    n = normalised_media(c)
    place = F.row_number().over(W.Window.partitionBy("document_id").orderBy("sentence_idx", "sentence_hash"))
    return n.select("document_id", "sentence_idx", place.alias("place"), "sentence_hash")


def ordered_children(children: DataFrame, keys: list[str]) -> DataFrame:
    """children(keys, parent, idx, child) with `place`: by where the child first stands in its parent as a word, then by index."""
    # Neither side holds a character that patterns give a meaning, but for dots and the like, which are quoted.
    needle = F.concat(F.lit(r"\b"), F.regexp_replace(F.lower(F.trim("child")), r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b"))
    at = F.regexp_instr(F.lower("parent"), needle)
    first = F.when((F.trim("child") != "") & (at > 0), at).otherwise(F.lit((1 << 31) - 1))
    return children.withColumn("place", F.row_number().over(W.Window.partitionBy(*keys).orderBy(first, "idx")))


def viewer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that a viewer shows of each phrase: its words in the order they stand in the sentence, without repeats of the one before."""
    n = V.nodes(spark, sf).where("type = 'Word'").select("seq", "parent", F.col("sentence"), F.col("preorder").alias("idx"), F.when(F.col("preorder") % 9 == 0, F.lit("")).otherwise(F.col("content")).alias("child"))
    o = ordered_children(n.withColumnRenamed("parent", "phrase").withColumnRenamed("sentence", "parent"), ["seq", "phrase"]).where("trim(child) <> ''")
    before = F.lag(F.lower("child")).over(W.Window.partitionBy("seq", "phrase").orderBy("place"))
    kept = o.withColumn("repeat", F.coalesce(before == F.lower("child"), F.lit(False))).where("not repeat")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "child"))), lambda x: x["child"]), " ")
    return kept.groupBy("seq", "phrase").agg(F.count(F.lit(1)).alias("shown"), F.sha2(joined, 256).alias("text_sha256"))


#: What a viewer says of features that are off, and of a submitted file.
UI_REASONS = {"phonetic": "Unavailable in offline mode (license/deployment gate).", "db_persistence": "Unavailable in offline mode (requires backend connectivity)."}
UI_FEEDBACK = {"local": ("info", "Local processing started"), "other": ("error", "File rejected by media policy")}
#: What a refused feature request is told.
REFUSED = {"phonetic": "phonetic is disabled by runtime capabilities", "db_persistence": "db persistence is disabled by runtime capabilities"}


def ui_state(spark: SparkSession, sf: str) -> DataFrame:
    """Badges and reasons of every capability row, and the features that a request for all would be refused."""
    m = media.capability_matrix(spark, sf)
    on = lambda c, name: F.when(~F.col(c), UI_REASONS[name]).otherwise("")
    refused = F.array_compact(F.array(*[F.when(~F.col(f"{f}_enabled"), F.lit(f)) for f in REFUSED]))
    return m.select(
        "mode", "policy", "deployment", F.concat(F.lit("Mode: "), "mode").alias("mode_badge"), F.concat(F.lit("Deployment: "), "deployment").alias("deployment_badge"), F.when(F.col("phonetic_enabled"), "Phonetic: on").otherwise("Phonetic: off").alias("phonetic_badge"),
        on("phonetic_enabled", "phonetic").alias("phonetic_reason"), on("db_persistence_enabled", "db_persistence").alias("db_reason"), F.array_join(refused, ",").alias("refused"),
    )


def media_submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Submitted files by route: what the viewer shows, whether a job is made, how many."""
    r = media.media_route(spark, sf)
    local = F.col("route") == "local"
    pick = lambda i: F.when(local, UI_FEEDBACK["local"][i]).otherwise(UI_FEEDBACK["other"][i])
    return r.groupBy("route", pick(0).alias("severity"), pick(1).alias("title"), local.alias("processed_locally")).agg(F.count(F.lit(1)).alias("n"), F.min("figures").alias("least"))


ARTIFACTS = ("full_text.txt", "media_contract.json", "contract_sentences.json", "sentence_link.json", "semantic_units_runtime.json", "bilingual_objects_runtime.json", "subtitles_en.srt", "subtitles_bilingual.srt")
#: Letters and digits: their JSON and their text are the same in any writer.
_PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' '{g}))"
_RU = "CASE sent_idx % 3 WHEN 0 THEN upper(body) WHEN 1 THEN '' ELSE body END"


def media_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """The eight artifacts of every document, one row each: digest and length of its content.

    A document's sentences meet in one row; what is collected is bounded by the document.
    """
    t = media.timeline(spark, sf).withColumn("body", F.expr(_PLAIN.format(g=""))).where("body <> ''").withColumn("ru", F.expr(_RU))
    t = t.select("doc_id", F.struct("sent_idx", "body", "ru", "start_ms", "end_ms", T.sentence_hash("body", "sent_idx").alias("hash")).alias("s"))
    d = t.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("xs"))
    srt = lambda body: F.array_join(F.transform(F.filter("xs", lambda x: body(x) != ""), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), media.srt_time(x["start_ms"]), F.lit(" --> "), media.srt_time(F.when(x["end_ms"] <= x["start_ms"], x["start_ms"] + 1000).otherwise(x["end_ms"])), F.lit("\n"), body(x), F.lit("\n"))), "\n")
    both = lambda x: F.when((x["body"] != "") & (x["ru"] != ""), F.concat(x["body"], F.lit("\n"), x["ru"])).otherwise(F.concat(x["body"], x["ru"]))
    full = F.array_join(F.transform("xs", lambda x: x["body"]), " ")
    links = F.to_json(F.transform("xs", lambda x: F.struct(x["sent_idx"].alias("sentence_idx"), x["hash"].alias("sentence_hash"))))
    contract = F.to_json(F.transform("xs", lambda x: F.struct(x["hash"].alias("sentence_hash"), F.struct(x["body"].alias("content"), F.lit("Sentence").alias("type")).alias("node"))))
    media_rows = F.transform("xs", lambda x: F.struct(x["sent_idx"].alias("sentence_idx"), x["body"].alias("sentence_text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["hash"].alias("sentence_hash")))
    whole = F.to_json(F.struct(F.col("doc_id").alias("document_id"), F.lit("text").alias("source_type"), F.sha2(full, 256).alias("text_hash"), media_rows.alias("media_sentences")))
    legacy = F.to_json(F.transform("xs", lambda x: F.struct((x["sent_idx"] + 1).alias("id"), x["body"].alias("text_eng"), x["start_ms"].alias("start"), x["end_ms"].alias("end"), x["ru"].alias("text_ru"))))
    contents = (full, whole, contract, links, legacy, legacy, srt(lambda x: x["body"]), srt(both))
    rows = F.array(*[F.struct(F.lit(name).alias("artifact"), F.sha2(c, 256).alias("sha256"), F.length(c).alias("n_chars")) for name, c in zip(ARTIFACTS, contents)])
    return d.select("doc_id", F.inline(rows))


# --- note reports

_COUNTS = ("nodes", "model_notes", "fallback_notes", "rejected_nodes", "l1_exact", "l2_drop_tam", "l3_level_pos", "l4_fallback", "backoff_nodes", "tam_drop_nodes", "semantic_mismatch_nodes")
_RATES = {
    "accepted_note_rate": "model_notes", "fallback_rate": "fallback_notes", "semantic_mismatch_rate": "semantic_mismatch_nodes", "backoff_rate": "backoff_nodes", "tam_drop_rate": "tam_drop_nodes",
    "coverage_l1_exact": "l1_exact", "coverage_l2_drop_tam": "l2_drop_tam", "coverage_l3_level_pos": "l3_level_pos", "coverage_l4_level_fallback": "l4_fallback",
}


def note_probes(spark: SparkSession, sf: str) -> DataFrame:
    """The eleven counters of each document's nodes, in the two-stage mode: counted sentence by sentence (note_totals), so that a few numbers of each document are shuffled."""
    from . import note_totals

    docs = V.tagged_sentences(spark, sf).select(F.floor(F.col("seq") / 100_000).alias("doc_id"), F.array_join("toks", " ").alias("words"))
    made = docs.mapInArrow(note_totals.counted, "doc_id long, " + ", ".join(f"{f} long" for f in note_totals.FIELDS))
    s = made.groupBy("doc_id").agg(*[F.sum(f).alias(f) for f in note_totals.FIELDS])
    # The mode knows no fallback notes, and only selects compatible templates.
    none = F.lit(0).cast("long")
    return s.select("doc_id", "nodes", "model_notes", none.alias("fallback_notes"), "rejected_nodes", *note_totals.FIELDS[3:7], (F.col("nodes") - F.col("l1_exact")).alias("backoff_nodes"), "tam_drop_nodes", none.alias("semantic_mismatch_nodes"))


def _report(of: str = "") -> list[Column]:
    """What a report says of the totals in columns, or in the fields of a struct."""
    c = lambda name: F.col(f"{of}.{name}" if of else name)
    rate = lambda name: F.coalesce(F.round(F.try_divide(c(name), c("nodes")), 6), F.lit(0.0))
    return [c("probe_count").alias("probe_count"), c("nodes").alias("total_nodes"), c("rejected_nodes").alias("rejected_nodes_total"), *[rate(x).alias(name) for name, x in _RATES.items()]]


def note_report(probes: DataFrame) -> DataFrame:
    """One row: totals of all probes and their nine rates."""
    s = probes.agg(F.count(F.lit(1)).alias("probe_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])
    return s.select(*_report())


def note_reports(probes: DataFrame, **sides: Column) -> DataFrame:
    """One row with the report of each side's probes as a struct: the probes are counted once."""
    total = lambda where: F.struct(F.count_if(where).alias("probe_count"), *[F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).alias(c) for c in _COUNTS])
    s = probes.agg(*[total(where).alias(name) for name, where in sides.items()])
    return s.select(*[F.struct(*_report(name)).alias(name) for name in sides])


def note_probe_counters(spark: SparkSession, sf: str) -> DataFrame:
    return note_probes(spark, sf)


def note_probe_report(spark: SparkSession, sf: str) -> DataFrame:
    return note_report(note_probes(spark, sf))


def lenient_number(c: Column) -> Column:
    """A number, or text that is one; anything else counts as 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


#: Checks by name: report, metric, direction (1: no less, -1: no more); thresholds widen or narrow them.
REGRESSION = (
    ("train_eval_exact_match_non_regression", "eval_exact_match", 1), ("train_eval_loss_non_increase", "eval_loss", -1), ("qc_accepted_note_rate_non_regression", "accepted_note_rate", 1), ("qc_fallback_rate_non_increase", "fallback_rate", -1),
    ("qc_rejected_nodes_non_increase", "rejected_nodes_total", -1), ("qc_semantic_mismatch_non_increase", "semantic_mismatch_rate", -1),
)


def regression_checks(base: DataFrame, candidate: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The eight checks of two one-row reports (name, passed, baseline, candidate, threshold) and whether all passed.

    thresholds: by metric the least gain (direction 1) or the most loss (direction -1) that is asked for.
    """
    # Two reports of one row each.
    return _checks(_side(base, "b", base.columns).crossJoin(_side(candidate, "c", candidate.columns)), thresholds)


_METRICS = (*[m for _, m, _ in REGRESSION], "probe_count", "total_nodes")


def _side(report: DataFrame, side: str, held: list[str]) -> DataFrame:
    return report.select(*[(lenient_number(F.col(m)) if m in held else F.lit(0.0)).alias(f"{side}_{m}") for m in _METRICS])


def _checks(sides: DataFrame, thresholds: dict[str, float] | None) -> DataFrame:
    t = thresholds or {}
    rows = []
    for name, m, direction in REGRESSION:
        edge = F.col(f"b_{m}") + F.lit(float(t.get(m, 0.0)))
        rows.append(F.struct(F.lit(name).alias("name"), (F.col(f"c_{m}") >= edge if direction > 0 else F.col(f"c_{m}") <= edge).alias("passed"), F.col(f"b_{m}").alias("baseline"), F.col(f"c_{m}").alias("candidate"), F.lit(float(t.get(m, 0.0))).alias("threshold")))
    for side, name in (("b", "baseline"), ("c", "candidate")):
        rows.append(F.struct(F.lit(f"contract_validity_{name}_qc_present").alias("name"), ((F.col(f"{side}_probe_count") > 0) & (F.col(f"{side}_total_nodes") > 0)).alias("passed"), F.col("b_total_nodes").alias("baseline"), F.col("c_total_nodes").alias("candidate"), F.lit(0.0).alias("threshold")))
    checks = sides.select(F.array(*rows).alias("checks"))
    return checks.withColumn("overall_passed", F.forall("checks", lambda x: x["passed"])).select("overall_passed", F.inline("checks"))


def regression_report(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents as baseline, odd ones as candidate; a loss and a text that is no number stand for training metrics."""
    even = F.col("doc_id") % 2
    both = note_reports(note_probes(spark, sf), b=even == 0, c=even == 1)
    said = {"b": {"eval_exact_match": F.lit("0.25"), "eval_loss": F.lit(0.7)}, "c": {"eval_exact_match": F.lit("n/a"), "eval_loss": F.lit(0.65)}}
    sides = both.select(*[lenient_number(said[k][m] if m in said[k] else F.col(f"{k}.{m}")).alias(f"{k}_{m}") for k in said for m in _METRICS])
    return _checks(sides, {"accepted_note_rate": -0.05, "rejected_nodes_total": 10_000_000.0})


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The nodes of that id: at most one a sentence."""
    return nodes.where(F.col("node_id") == node_id)


def node_search(spark: SparkSession, sf: str) -> DataFrame:
    n = V.nodes(spark, sf).select("seq", F.concat(F.lit("n"), (F.col("preorder") + 1).cast("string")).alias("node_id"), "type", F.sha2("content", 256).alias("content_sha256"))
    return node_by_id(n, "n3")


def probe_texts(spark: SparkSession, path: str | None = None, default: tuple[str, ...] = ("She should have trusted her instincts before making the decision.",)) -> DataFrame:
    """text: the probes of a JSON file (an array of strings, else an error) or the built-in ones."""
    rows = list(default)
    if path is not None:
        rows = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        if not isinstance(rows, list) or not all(isinstance(x, str) for x in rows):
            raise ValueError("probes_file must contain a JSON array of strings")
    return spark.createDataFrame([(x,) for x in rows], "text string")


QUERIES = {f.__name__: f for f in (
    persist_inference, run_ledger, account_upsert, account_lookup, review_append, client_appends, status_updates, selected_projects, recent_projects, media_sentence_normalize, viewer_tokens, ui_state, media_submissions, media_artifacts,
    note_probe_counters, note_probe_report, regression_report, node_search,
)}

_KEY = f"sha256('v1|' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '|' || lower(lang) || '|en|' || '{CONTEXT}')"
_ACCOUNTS = "WITH a AS (SELECT c_custkey AS r, sha256('salt:' || '+49151' || lpad(CAST(c_custkey % 400 AS VARCHAR), 7, '0')) AS phone_hash FROM customer), accounts AS (SELECT phone_hash, min(r) AS id, min(r) AS created, max(r) AS updated FROM a GROUP BY 1)"
_UUID = "CAST(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS VARCHAR)"
_EDITS = "(['notes[0].text', 'cefr_level', 'translation.text', 'node_id', '', 'features.tense', 'cefr_level', 'synonyms[2]'])[(conv_id * 3 + turn) % 8 + 1]"
_PROBES_SQL = A._PICKED + f""", p0 AS (SELECT *, {A._JUDGE('note', 'note_suits')} FROM sel), p1 AS (SELECT *, CASE WHEN level IN ('L1_EXACT', 'L2_DROP_TAM') THEN note_suits ELSE note IS NOT NULL END AS tried FROM p0),
p2 AS (SELECT *, tried AND (type = 'Word' OR row_number() OVER (PARTITION BY seq, CASE WHEN tried AND type <> 'Word' THEN lower(note) END ORDER BY preorder) = 1) AS got FROM p1),
probes AS (SELECT seq // 100000 AS doc_id, count(*) AS nodes, count(*) FILTER (got) AS model_notes, 0::BIGINT AS fallback_notes, count(*) FILTER (rejects > 0) AS rejected_nodes, count(*) FILTER (level = 'L1_EXACT') AS l1_exact, count(*) FILTER (level = 'L2_DROP_TAM') AS l2_drop_tam, count(*) FILTER (level = 'L3_LEVEL_POS') AS l3_level_pos, count(*) FILTER (level = 'L4_FALLBACK') AS l4_fallback,
  count(*) FILTER (level <> 'L1_EXACT') AS backoff_nodes, count(*) FILTER (reason = 'tam_dropped') AS tam_drop_nodes, 0::BIGINT AS semantic_mismatch_nodes FROM p2 GROUP BY 1)"""
_REPORT = lambda where: "SELECT count(*) AS probe_count, CAST(sum(nodes) AS BIGINT) AS total_nodes, CAST(sum(rejected_nodes) AS BIGINT) AS rejected_nodes_total, " + ", ".join(f"round(CAST(sum({c}) AS DOUBLE) / sum(nodes), 6) AS {n}" for n, c in _RATES.items()) + f" FROM probes {where}"
_ART = media._TIMELINE + f""", m0 AS (SELECT doc_id, sent_idx, start_ms, start_ms + ms AS end_ms, {_PLAIN.format(g=", 'g'")} AS body FROM timeline), m AS MATERIALIZED (SELECT *, {_RU} AS ru, sha256(body || '|' || sent_idx) AS hash FROM m0 WHERE body <> ''),
c AS (SELECT *, {media._SRT('start_ms')} || ' --> ' || {media._SRT('CASE WHEN end_ms <= start_ms THEN start_ms + 1000 ELSE end_ms END')} AS times, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS n FROM m),
g AS (SELECT doc_id, string_agg(body, ' ' ORDER BY sent_idx) AS full_text, '[' || string_agg('{{"sentence_idx":' || sent_idx || ',"sentence_hash":"' || hash || '"}}', ',' ORDER BY sent_idx) || ']' AS links,
  '[' || string_agg('{{"sentence_hash":"' || hash || '","node":{{"content":"' || body || '","type":"Sentence"}}}}', ',' ORDER BY sent_idx) || ']' AS contracts,
  '[' || string_agg('{{"sentence_idx":' || sent_idx || ',"sentence_text":"' || body || '","start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"sentence_hash":"' || hash || '"}}', ',' ORDER BY sent_idx) || ']' AS media_rows,
  '[' || string_agg('{{"id":' || (sent_idx + 1) || ',"text_eng":"' || body || '","start":' || start_ms || ',"end":' || end_ms || ',"text_ru":"' || ru || '"}}', ',' ORDER BY sent_idx) || ']' AS legacy,
  string_agg(n || chr(10) || times || chr(10) || body || chr(10), chr(10) ORDER BY sent_idx) AS en, string_agg(n || chr(10) || times || chr(10) || CASE WHEN ru <> '' THEN body || chr(10) || ru ELSE body END || chr(10), chr(10) ORDER BY sent_idx) AS bi FROM c GROUP BY doc_id),
h AS (SELECT *, '{{"document_id":' || doc_id || ',"source_type":"text","text_hash":"' || sha256(full_text) || '","media_sentences":' || media_rows || '}}' AS whole FROM g)"""
_CHILD = "CASE WHEN preorder % 9 = 0 THEN '' ELSE content END"
ORACLES = {
    "persist_inference": V.sql(V.SENTENCES, f""", v AS (SELECT seq, text, lang, 'r1' AS run FROM sentences UNION ALL SELECT seq, text, lang, 'r2' FROM sentences WHERE seq % 3 = 0), w AS (SELECT *, {_KEY} AS k, length(text) AS n, {_TAM} AS tam FROM v),
      r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run DESC, seq DESC) AS last, min(run) OVER (PARTITION BY k) AS created_run FROM w)
      SELECT k AS sentence_key, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS source_sha256, lang AS source_lang, 'en' AS target_lang, 'v1' AS hash_version, run AS last_run_id, '{CONTEXT}' AS pipeline_context, '{{"type":"Sentence","n":' || n || '}}' AS contract_payload, lang || '->en' AS language_pair, tam AS tam_construction,
        CAST(n % 7 AS INTEGER) AS backoff_nodes_count, CAST(n % 5 AS INTEGER) AS backoff_leaf_nodes_count, CAST(greatest(0, n % 7 - n % 5) AS INTEGER) AS backoff_aggregate_nodes_count, CAST(n % 3 AS INTEGER) AS backoff_unique_spans_count, created_run, run AS updated_run FROM r WHERE last = 1"""),
    "run_ledger": V.sql(V.SENTENCES, f""", n AS (SELECT 'run' || (doc_id % 9) AS run_id, doc_id, count(*) AS c FROM sentences GROUP BY 1, 2) SELECT run_id, arg_max(c, doc_id) AS sentence_count, '{CONTEXT}' AS pipeline_context, 'v1' AS hash_version, min(doc_id) AS created, max(doc_id) AS updated FROM n GROUP BY run_id"""),
    "account_upsert": _ACCOUNTS + " SELECT * FROM accounts",
    "account_lookup": _ACCOUNTS + " SELECT * FROM accounts WHERE phone_hash = sha256('salt:+491510000007')",
    "review_append": f"""WITH e AS (SELECT conv_id * 1000 + turn AS edit_id, conv_id AS review_id, 'n' || (turn % 3) AS node_id, {_EDITS} AS field_path, '{{"v":"' || (['B1', 'b2', 'A2', 'Z9', 'C1'])[(conv_id * 3 + turn) % 5 + 1] || '"}}' AS after_json FROM conversations), l AS (SELECT coalesce(max(edit_id) FILTER (review_id < 10), 0) AS m FROM e)
      SELECT edit_id AS id, review_id, node_id, field_path, after_json FROM e WHERE review_id < 10 UNION ALL SELECT row_number() OVER (ORDER BY edit_id) + m, review_id, node_id, field_path, after_json FROM e, l WHERE review_id >= 10""",
    "client_appends": f"""WITH k AS (SELECT 'projects' AS t, CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT 'media_files', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'local_edits', CAST(conv_id * 1000 + turn AS VARCHAR) FROM conversations
      UNION ALL SELECT 'backend_jobs', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT 'sync_requests', CAST(o_orderkey AS VARCHAR) FROM orders WHERE floor(o_totalprice * 2000) > 262144000), h AS (SELECT t, md5(t || '|' || key) AS h FROM k), u AS (SELECT t, {_UUID} AS id FROM h)
      SELECT t AS "table", count(*) AS n, count(DISTINCT id) AS ids, min(id) AS least FROM u GROUP BY t""",
    "status_updates": "WITH j AS (SELECT event_id AS id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in store.STATUS.items()) + " END AS status FROM events), u AS (SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN status = 'queued' THEN 'processing' ELSE 'completed' END ELSE status END AS status, id % 4 = 0 AS touched FROM j) SELECT status, touched, count(*) AS n, max(id) AS last_id FROM u GROUP BY 1, 2",
    "selected_projects": "SELECT DISTINCT o_custkey + o_orderkey % 3 * 100000 AS project_id FROM orders WHERE o_custkey + o_orderkey % 3 * 100000 IN (SELECT c_custkey FROM customer)",
    "recent_projects": "SELECT o_custkey AS project_id, max(o_orderkey) AS updated_at, count(*) AS files FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
    "media_sentence_normalize": f"""WITH r AS (SELECT conv_id AS document_id, turn AS place, {', '.join(f'{e} AS {k}' for k, e in _RAW.items())} FROM conversations), n AS (SELECT document_id, coalesce(sentence_idx, place) AS sentence_idx, trim(coalesce(nullif(sentence_text, ''), nullif(text, ''), nullif(text_eng, ''), '')) AS t, sentence_hash FROM r),
      h AS (SELECT document_id, sentence_idx, coalesce(sentence_hash, sha256(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) || '|' || sentence_idx)) AS sentence_hash FROM n WHERE t <> '')
      SELECT document_id, sentence_idx, CAST(row_number() OVER (PARTITION BY document_id ORDER BY sentence_idx, sentence_hash) AS INTEGER) AS place, sentence_hash FROM h""",
    "viewer_tokens": V.sql(V.NODES, f""", sent AS (SELECT seq, content AS sentence FROM nodes WHERE type = 'Sentence'), w AS (SELECT n.seq, n.parent AS phrase, sentence, n.preorder AS idx, {_CHILD} AS child FROM nodes n JOIN sent USING (seq) WHERE n.type = 'Word'), v AS (SELECT * FROM w WHERE child <> ''),
      a AS (SELECT *, CASE WHEN regexp_matches(sentence, '\\b' || child || '\\b') THEN length(regexp_extract(sentence, '^(.*?)\\b' || child || '\\b', 1)) ELSE 2147483647 END AS pos_at FROM v), o AS (SELECT *, lag(child) OVER (PARTITION BY seq, phrase ORDER BY pos_at, idx) AS before FROM a)
      SELECT seq, phrase, count(*) AS shown, sha256(string_agg(child, ' ' ORDER BY pos_at, idx)) AS text_sha256 FROM o WHERE before IS DISTINCT FROM child GROUP BY 1, 2"""),
    "ui_state": f"""WITH c AS ({media.ORACLES['capability_matrix']}) SELECT mode, policy, deployment, 'Mode: ' || mode AS mode_badge, 'Deployment: ' || deployment AS deployment_badge, CASE WHEN phonetic_enabled THEN 'Phonetic: on' ELSE 'Phonetic: off' END AS phonetic_badge, CASE WHEN phonetic_enabled THEN '' ELSE '{UI_REASONS['phonetic']}' END AS phonetic_reason,
      CASE WHEN db_persistence_enabled THEN '' ELSE '{UI_REASONS['db_persistence']}' END AS db_reason, concat_ws(',', CASE WHEN NOT phonetic_enabled THEN 'phonetic' END, CASE WHEN NOT db_persistence_enabled THEN 'db_persistence' END) AS refused FROM c""",
    "media_submissions": f"WITH r AS ({media.ORACLES['media_route']}) SELECT route, CASE WHEN route = 'local' THEN 'info' ELSE 'error' END AS severity, CASE WHEN route = 'local' THEN '{UI_FEEDBACK['local'][1]}' ELSE '{UI_FEEDBACK['other'][1]}' END AS title, route = 'local' AS processed_locally, count(*) AS n, min(figures) AS least FROM r GROUP BY 1, 2, 3, 4",
    "media_artifacts": V.sql(_ART, " UNION ALL ".join(f"SELECT doc_id, '{a}' AS artifact, sha256({c}) AS sha256, CAST(length({c}) AS INTEGER) AS n_chars FROM h" for a, c in zip(ARTIFACTS, ("full_text", "whole", "contracts", "links", "legacy", "legacy", "en", "bi")))),
    "note_probe_counters": V.sql(_PROBES_SQL, "SELECT * FROM probes"),
    "note_probe_report": V.sql(_PROBES_SQL, _REPORT("")),
    "regression_report": V.sql(_PROBES_SQL, f""", b AS ({_REPORT('WHERE doc_id % 2 = 0')}), c AS ({_REPORT('WHERE doc_id % 2 = 1')}), x AS (SELECT 'train_eval_exact_match_non_regression' AS name, false AS passed, 0.25::DOUBLE AS baseline, 0.0::DOUBLE AS candidate, 0.0::DOUBLE AS threshold UNION ALL SELECT 'train_eval_loss_non_increase', true, 0.7, 0.65, 0.0
      UNION ALL SELECT 'qc_accepted_note_rate_non_regression', c.accepted_note_rate >= b.accepted_note_rate - 0.05::DOUBLE, b.accepted_note_rate, c.accepted_note_rate, -0.05 FROM b, c UNION ALL SELECT 'qc_fallback_rate_non_increase', c.fallback_rate <= b.fallback_rate, b.fallback_rate, c.fallback_rate, 0.0 FROM b, c
      UNION ALL SELECT 'qc_rejected_nodes_non_increase', c.rejected_nodes_total <= b.rejected_nodes_total + 10000000, b.rejected_nodes_total, c.rejected_nodes_total, 10000000.0 FROM b, c UNION ALL SELECT 'qc_semantic_mismatch_non_increase', c.semantic_mismatch_rate <= b.semantic_mismatch_rate, b.semantic_mismatch_rate, c.semantic_mismatch_rate, 0.0 FROM b, c
      UNION ALL SELECT 'contract_validity_baseline_qc_present', b.probe_count > 0, b.total_nodes, c.total_nodes, 0.0 FROM b, c UNION ALL SELECT 'contract_validity_candidate_qc_present', c.probe_count > 0, b.total_nodes, c.total_nodes, 0.0 FROM b, c)
      SELECT bool_and(passed) OVER () AS overall_passed, * FROM x"""),
    "node_search": V.sql(V.NODES, "SELECT seq, 'n3' AS node_id, type, sha256(content) AS content_sha256 FROM nodes WHERE preorder = 2"),
}
