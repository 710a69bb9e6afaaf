"""Behaviour of single operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import providers, text
from lexloom.operators import corpus, dataset, media, qc, store, tree
from lexloom.plans import views
from lexloom.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_squeeze_takes_unicode_spaces(spark):
    assert one(spark, text.squeeze("t"), t=" a  b\n c ") == "a b c"


def test_target_reason(spark):
    rows = [("  ",), ("has quality_flags here.",), ("Sentence: a b.",), ("One. Two. Three.",), ("A fine note.",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(text.target_reason("t").alias("x")).collect()]
    assert got == ["EMPTY", "TELEMETRY", "LOW_QUALITY_STYLE", "LOW_QUALITY_STYLE", None]


def test_phone(spark):
    rows = [("+49 (151) 234-5678",), ("123",), ("",), ("++491512345678",)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(store.phone_e164(F.col("t")).alias("x")).collect()]
    assert got == ["+491512345678", None, None, None]


def test_ingest_folds_over_sources(spark):
    rows = [(1, "a", "first text here"), (2, "a", "FIRST  text here"), (3, "a", "short"), (4, "b", "first text here"), (5, "b", "second text here"), (6, "b", "third text here"), (7, "b", "fourth text here")]
    s = spark.createDataFrame(rows, "seq long, source string, text string")
    got = {r["source"]: r.asDict() for r in corpus.ingest(s, ["a", "b"], 2).collect()}
    assert got["a"] == {"source": "a", "read_rows": 3, "kept": 1, "length_dropped": 1, "duplicates": 1}
    assert got["b"] == {"source": "b", "read_rows": 3, "kept": 2, "length_dropped": 0, "duplicates": 1}


def test_cap_and_balance(spark):
    rows = [(i, f"in{i % 4}", "T", "Word", "none" if i % 3 else "x") for i in range(12)]
    e = spark.createDataFrame(rows, "seq long, input string, target string, level string, tam_bucket string")
    assert [r["seq"] for r in dataset.capped(e, 3).orderBy("seq").collect()] == [0, 1, 2]
    assert {r["tam_bucket"]: r["count"] for r in dataset.balanced(e).groupBy("tam_bucket").count().collect()} == {"none": 4, "x": 4}


def test_split_sizes_truncate(spark):
    e = spark.createDataFrame([(i, "a") for i in range(57)], "seq long, input string")
    got = {r["split"]: r["count"] for r in dataset.split(e).groupBy("split").count().collect()}
    assert got == {"test": 5, "dev": 5, "train": 47}


def test_ranks_without_global_sort(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"))
    got = [r["h"] for r in views.by_rank(df, "h").orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 500


def test_feedback_mix(spark):
    a, b = spark.range(3), spark.range(2)
    assert dataset.mix_feedback(a, b, 0).count() == 3 and dataset.mix_feedback(a, b, 3).count() == 9
    with pytest.raises(ValueError):
        dataset.mix_feedback(a, b, -1)


def test_upsert_last_version_wins(spark):
    state = spark.createDataFrame([("k", "old", 1)], "key string, v string, version long")
    new = spark.createDataFrame([("k", "new", 2), ("m", "x", 1)], "key string, v string, version long")
    got = {r["key"]: (r["v"], r["created"]) for r in store.upsert(state, new, ["key"], "version").collect()}
    assert got == {"k": ("new", 1), "m": ("x", 1)}


def test_set_path_pads_and_makes():
    assert tree.set_path({}, "a.b[2].c", "x") == {"a": {"b": [None, None, {"c": "x"}]}}
    assert tree.set_path({"notes": [{"text": "old"}]}, "notes[0].text", "new") == {"notes": [{"text": "new"}]}


def test_srt_time(spark):
    assert spark.range(1).select(media.srt_time(F.lit(3_723_045)).alias("x")).first()["x"] == "01:02:03,045"


def test_lcs():
    assert qc.lcs("a b c d".split(), "a x c d".split()) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n\n{"id": "own", "text": "two"}\n{"text": "three"}\n')
    spec = readers.SourceSpec("src", str(tmp_path / "a.jsonl"), "u", "mit")
    assert {(r["id"], r["text"]) for r in readers.rows_of(spark, spec).collect()} == {("src_0000000", "one"), ("own", "two"), ("src_0000003", "three")}
    (tmp_path / "b.txt").write_text("x\n\n y \n")
    assert {r["id"] for r in readers.rows_of(spark, readers.SourceSpec("t", str(tmp_path / "b.txt"), "u", "mit", format="txt")).collect()} == {"t_0000000", "t_0000002"}
    (tmp_path / "c.json").write_text(json.dumps([{"text": "p"}, {"text": "q", "id": "i"}]))
    assert {r["id"] for r in readers.rows_of(spark, readers.SourceSpec("j", str(tmp_path / "c.json"), "u", "mit", format="json")).collect()} == {"j_0000000", "i"}
    assert readers.jsonl(spark, str(tmp_path / "none"), "a string", missing_ok=True).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"name": "n", "input_path": "p", "source_url": "u", "license": "mit", "format": "xml"}]}))
    with pytest.raises(ValueError):
        readers.specs(str(tmp_path / "s.json"))


def test_more_sources(spark, tmp_path):
    (tmp_path / "u.conllu").write_text("# text = A cat sat.\n1\tA\n# text = a cat SAT.\n# text = Dogs ran.\n")
    assert {r["text"] for r in readers.conllu(spark, str(tmp_path / "u.conllu")).collect()} == {"A cat sat.", "Dogs ran."}
    (tmp_path / "f.xml").write_text("<r><DESCRIPTION><b>Hello there world.</b> Second one here.</DESCRIPTION></r>")
    assert {r["text"] for r in readers.rss(spark, str(tmp_path / "f.xml")).collect()} == {"Hello there world.", "Second one here."}
    (tmp_path / "k.json").write_text(json.dumps({"Hi.": {"type": "Sentence", "content": "Hi.", "rejected_candidates": ["x"]}}))
    assert readers.contracts(spark, str(tmp_path / "k.json")).first()["content"] == "Hi."
    (tmp_path / "n.json").write_text(json.dumps({"patterns": ["a", "b"]}))
    assert readers.hard_negative_patterns(spark, str(tmp_path / "n.json")).count() == 2
    assert readers.directory(spark, str(tmp_path / "n.json")).first()["bytes"] > 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "a", "train"), ("d", "c", "test")], "z string, y string, split string")
    writers.jsonl(df, str(tmp_path / "o"), sort_keys=True, single=True)
    assert spark.read.text(str(tmp_path / "o")).first()["value"].startswith('{"split"')
    writers.splits(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("split=*")} == {"split=train", "split=test"}
    assert writers.report(df.groupBy().count(), str(tmp_path / "r.json")) == {"count": 2}
    writers.replace_partitions(df, str(tmp_path / "p"), "split")
    writers.replace_partitions(df.where("split = 'test'").withColumn("z", F.lit("new")), str(tmp_path / "p"), "split")
    assert {r["z"] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"b", "new"}


def test_providers(spark):
    df = spark.createDataFrame([("é",), ("é",)], "t string")
    assert df.select(providers.nfc("t").alias("x")).first()["x"] == "é"
    got = providers.enrich(df, ["t"], lambda rows: rows["t"].str.upper(), "up").collect()
    assert len(got) == 2 and got[0]["up"] == "É"
