"""The service's entry points on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom import api
from lexloom.sources.writers import CLIENT_TABLES


@pytest.fixture(scope="module")
def service(spark):
    tree = json.dumps({"node_id": "n1", "linguistic_elements": [{"node_id": "n2", "notes": [{"text": "old"}]}]})
    rows = {
        "projects": [("p1", "One", "2024-01-01", "2024-01-02"), ("p2", "Two", "2024-01-01", "2024-01-03")],
        "media_files": [("f1", "p1", "a.txt", "/a", 10, 5, None, None), ("f2", "p1", "b.mp3", "/b", 20, 6, None, None), ("f3", "p2", "c", "/c", 1, 1, None, None)],
        "documents": [("d1", "p1", "f1", "text", "/a", "h", "completed", None, None), ("d2", "p1", "f1", "text", "/a", "h", "completed", None, None), ("d3", "p1", "f2", "text", "/b", "h", "processing", None, None)],
        "media_sentences": [("d1", 0, "Hi.", 0, 1, None, None, None, "s0"), ("d1", 1, "Hi.", 1, 2, None, None, None, "s1"), ("d1", 2, "Bye.", 2, 3, None, None, None, "s2")],
        "sentence_link": [("d1", 0, "s0"), ("d1", 1, "s1"), ("d1", 2, "sX")],
        "contract_sentences": [("d1", "s0", tree, None), ("d1", "s1", tree, None), ("d1", "s2", tree, None)],
        "workspace_state": [("selected_project", "p2", "2024-01-01"), ("selected_project", "p1", "2024-01-05"), ("media_file_settings:f2", '{"v": 1}', "2024-01-01"), ("translation_config", '[{"id": "lara", "enabled": true}]', "2024-01-01")],
    }
    tables = {}
    for name, values in rows.items():
        names = [c.split()[0] for c in CLIENT_TABLES[name].split(", ")]
        kinds = [c.split()[1] for c in CLIENT_TABLES[name].split(", ")]
        df = spark.createDataFrame(values, ", ".join(f"{n} {'string' if k == 'timestamp' else k}" for n, k in zip(names, kinds)))
        tables[name] = df.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])
    return api.Service(spark, tables)


def test_reads(service, spark):
    get = lambda path, *a: api.call(service, "GET", path, *a)
    assert get("/health").first()["status"] == "ok" and get("/api/ui-state").count() == 18
    assert [r["id"] for r in get("/api/projects").collect()] == ["p2", "p1"] and [r["id"] for r in get("/api/selected-project").collect()] == ["p1"]
    assert {r["id"]: (r["analyzed"], r["settings"]) for r in get("/api/files", "p1").collect()} == {"f1": (True, "{}"), "f2": (False, '{"v": 1}')}
    assert [r["display_key"] for r in get("/api/visualizer-payload", "d1").collect()] == ["Hi.", "Hi. #2"]
    status = get("/api/document-status", "d1").first()
    assert (status["status"], status["n_media_sentences"], status["n_sentence_link"], status["n_contract_sentences"]) == ("completed", 3, 3, 3)
    defaults = spark.createDataFrame([("lara", "custom", "Lara", False), ("m2m", "builtin", "M2M", True)], "id string, kind string, label string, enabled boolean")
    assert [(r["id"], r["enabled"]) for r in get("/api/translation-config", defaults).collect()] == [("m2m", True), ("lara", True)]
    with pytest.raises(LookupError):
        get("/nothing")


def test_writes(service, spark):
    post = lambda path, *a: api.call(service, "POST", path, *a)
    edits = spark.createDataFrame([("d1", "s0", "n2", "notes[0].text", "new"), ("d1", "s1", "n9", "x", "y")], "document_id string, sentence_hash string, node_id string, field_path string, value string")
    after = {r["sentence_hash"]: json.loads(r["sentence_node"]) for r in post("/api/apply-edit", edits).collect()}
    assert after["s0"]["linguistic_elements"][0]["notes"] == [{"text": "new"}] and len(after) == 3
    assert after["s1"]["linguistic_elements"][0]["notes"] == after["s2"]["linguistic_elements"][0]["notes"] == [{"text": "old"}]
    files = spark.createDataFrame([("a", 60, 1000), ("b", 3600, 1000), ("c", 0, 5)], "id string, duration_seconds int, size_bytes long")
    assert {r["id"]: (r["route"], r["severity"]) for r in post("/api/submit-media", files).collect()} == {"a": ("local", "info"), "b": ("reject", "error"), "c": ("error", "error")}
    new = spark.createDataFrame([("p1", "n", "/n", 1, 1)], "project_id string, name string, path string, size_bytes long, duration_seconds int")
    assert len(post("/api/register-media", new).first()["id"]) == 36
    with pytest.raises(ValueError, match="not there"):
        post("/api/register-media", new.withColumn("project_id", F.lit("p9")))
    assert post("/api/selected-project", "p2", "2024-02-01").first()["value"] == "p2"
    with pytest.raises(ValueError, match="p9"):
        post("/api/selected-project", "p9", "2024-02-01")
    texts = spark.createDataFrame([("/t", "a  b")], "path string, text string")
    assert post("/api/upload", texts).first()["text_hash"] == post("/api/upload", texts.withColumn("text", F.lit("a b"))).first()["text_hash"]
    good = '{"sentence_node": {}, "sentence_hash": "h"}'
    sentences = spark.createDataFrame([(0, "Hi.")], "sentence_idx int, sentence_text string")
    assert post("/api/sentence-contract", sentences, lambda: lambda request: good).first()["sentence_hash"] == "h"
