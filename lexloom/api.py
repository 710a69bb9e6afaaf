"""The service's entry points as functions on tables: each gives a DataFrame, and what is written is given back as rows to append or merge."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .functions import providers
from .functions import text as T
from .operators import ledger, media, tree
from .operators.store import latest


def _find(node: dict, node_id: str) -> dict | None:
    """The node of that id, depth first."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.get("node_id") == node_id:
            return at
        todo += [c for c in reversed(at.get("linguistic_elements") or []) if isinstance(c, dict)]
    return None


@F.pandas_udf(StringType())
def edited_contract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Trees (JSON) with a value set at a path of the node of an id; a tree without the node is as it was.

    The path is only known at run time, so this is Python, batch by batch.
    """
    for trees, ids, paths, values in batches:
        out = []
        for t, i, p, v in zip(trees, ids, paths, values):
            doc = json.loads(t)
            node = _find(doc, i)
            if node is not None:
                tree.set_path(node, p, v)
            out.append(json.dumps(doc, ensure_ascii=False, sort_keys=True))
        yield pd.Series(out)


class Service:
    """tables: projects, media_files, documents, media_sentences, sentence_link, contract_sentences, workspace_state, by name."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def health(self) -> DataFrame:
        return self.spark.createDataFrame([("ok",)], "status string")

    def ui_state(self) -> DataFrame:
        return ledger.ui_state(self.spark, "")

    def projects(self) -> DataFrame:
        return self.tables["projects"].orderBy(F.desc("updated_at"), "id")

    def _state(self, key: str) -> DataFrame:
        return latest(self.tables["workspace_state"].where(F.col("key") == key), ["key"], ["updated_at", "value"])

    def selected_project(self) -> DataFrame:
        """The selected project, if there is one of that id."""
        chosen = self._state("selected_project").select(F.col("value").alias("id"))
        return self.tables["projects"].join(chosen, "id", "left_semi")

    def select_project(self, project_id: str, now) -> DataFrame:
        """The state row to append; an unknown project is an error."""
        if self.tables["projects"].where(F.col("id") == project_id).limit(1).isEmpty():
            raise ValueError(f"no project {project_id}")
        return self.spark.createDataFrame([("selected_project", project_id)], "key string, value string").withColumn("updated_at", F.lit(now).cast("timestamp"))

    def files(self, project_id: str) -> DataFrame:
        """A project's files with their settings and whether a document of theirs is complete."""
        f = self.tables["media_files"].where(F.col("project_id") == project_id)
        done = self.tables["documents"].where("status = 'completed'").select(F.col("media_file_id").alias("id")).distinct().withColumn("done", F.lit(True))
        keys = self.tables["workspace_state"].where(F.startswith("key", F.lit("media_file_settings:")))
        settings = latest(keys, ["key"], ["updated_at", "value"]).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("id"), F.col("value").alias("settings"))
        j = f.join(done, "id", "left").join(settings, "id", "left")
        return j.select(*f.columns, F.coalesce("done", F.lit(False)).alias("analyzed"), F.coalesce("settings", F.lit("{}")).alias("settings"))

    def register_media(self, files: DataFrame) -> DataFrame:
        """Rows of files(project_id, name, path, size_bytes, duration_seconds) to append, with their ids; rows of unknown projects are an error."""
        projects = self.tables["projects"].select(F.col("id").alias("project_id"))
        if not files.join(projects, "project_id", "left_anti").isEmpty():
            raise ValueError("files of a project that is not there")
        return files.withColumn("id", ledger.row_uuid(F.lit("media_files"), F.col("project_id"), F.col("path")))

    def submit_media(self, files: DataFrame, max_minutes: int = media.MAX_MINUTES, max_mb: int = media.MAX_LOCAL_MB) -> DataFrame:
        """files(id, duration_seconds, size_bytes) with route, severity, title and message."""
        seconds, size = F.col("duration_seconds"), F.col("size_bytes")
        local = (seconds <= max_minutes * 60) & (size <= max_mb * 1024 * 1024)
        route = F.when((seconds <= 0) | (size <= 0), "error").when(local, "local").otherwise("reject")
        message = F.format_string(f"duration=%.2fm (limit_local={max_minutes}m), size=%.2fMB (limit_local={max_mb}MB)", seconds / 60.0, size / (1024.0 * 1024))
        said = lambda i: F.when(route == "local", ledger.UI_FEEDBACK["local"][i]).otherwise(ledger.UI_FEEDBACK["other"][i])
        return files.select("id", route.alias("route"), said(0).alias("severity"), said(1).alias("title"), message.alias("message"))

    def translation_config(self, defaults: DataFrame) -> DataFrame:
        """The defaults with the stored settings (a JSON list of providers) over them."""
        schema = "array<struct<id:string,kind:string,label:string,enabled:boolean>>"
        stored = self._state("translation_config").select(F.inline(F.from_json("value", schema)))
        return tree.merged_settings(defaults, stored)

    def visualizer_payload(self, document_id: str) -> DataFrame:
        """Display key and tree of each sentence of a document, by place."""
        of = lambda name: self.tables[name].where(F.col("document_id") == document_id)
        j = of("media_sentences").join(of("sentence_link").select("sentence_idx", "sentence_hash"), ["sentence_idx", "sentence_hash"]).join(of("contract_sentences").select("sentence_hash", "sentence_node"), "sentence_hash")
        n = F.expr("row_number() OVER (PARTITION BY sentence_text ORDER BY sentence_idx)")
        return j.withColumn("n", n).select("sentence_idx", F.when(F.col("n") == 1, F.col("sentence_text")).otherwise(F.concat("sentence_text", F.lit(" #"), F.col("n").cast("string"))).alias("display_key"), "sentence_hash", "sentence_node").orderBy("sentence_idx")

    def document_status(self, document_id: str) -> DataFrame:
        """One row: the document's status and how many sentences, links and contracts it has."""
        count = lambda name: self.tables[name].where(F.col("document_id") == document_id).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = self.tables["documents"].where(F.col("id") == document_id).select("id", "status")
        for name in ("media_sentences", "sentence_link", "contract_sentences"):
            out = out.crossJoin(F.broadcast(count(name)))  # one row each
        return out

    def apply_edits(self, edits: DataFrame) -> DataFrame:
        """contract_sentences after edits(document_id, sentence_hash, node_id, field_path, value), one a sentence: the node is found, the value set, the sentence merged back."""
        c = self.tables["contract_sentences"]
        j = c.join(edits, ["document_id", "sentence_hash"], "left")
        changed = edited_contract("sentence_node", "node_id", "field_path", "value")
        touched = j.where("node_id is not null").withColumn("sentence_node", changed).select(*c.columns)
        return touched.unionByName(j.where("node_id is null").select(*c.columns))

    def sentence_contracts(self, sentences: DataFrame, make_client: Callable[[], Callable[[dict], str]]) -> DataFrame:
        """Contracts of sentences(sentence_idx, sentence_text) by a backend."""
        return providers.requested_contracts(sentences, make_client)

    def uploaded(self, files: DataFrame) -> DataFrame:
        """Documents (id, text hash) of uploaded texts(path, text)."""
        return files.select(ledger.row_uuid(F.lit("documents"), F.col("path")).alias("id"), F.sha2(T.squeeze("text"), 256).alias("text_hash"), "path")


#: Method and path of each entry point.
ROUTES = {
    ("GET", "/health"): Service.health, ("GET", "/api/ui-state"): Service.ui_state, ("GET", "/api/projects"): Service.projects, ("GET", "/api/translation-config"): Service.translation_config, ("GET", "/api/selected-project"): Service.selected_project,
    ("GET", "/api/files"): Service.files, ("GET", "/api/visualizer-payload"): Service.visualizer_payload, ("GET", "/api/document-status"): Service.document_status, ("POST", "/api/upload"): Service.uploaded, ("POST", "/api/submit-media"): Service.submit_media,
    ("POST", "/api/selected-project"): Service.select_project, ("POST", "/api/register-media"): Service.register_media, ("POST", "/api/apply-edit"): Service.apply_edits, ("POST", "/api/sentence-contract"): Service.sentence_contracts,
}


def call(service: Service, method: str, path: str, *args, **named) -> DataFrame:
    """The answer of an entry point; an unknown one is an error."""
    if (method, path) not in ROUTES:
        raise LookupError(f"{method} {path}")
    return ROUTES[method, path](service, *args, **named)
