"""Sources, sinks and providers that need files, backends or models."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lexloom.functions import providers
from lexloom.operators import contract, ledger, skeleton
from lexloom.sources import readers, writers


def test_contract_documents_as_object_and_as_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Hi.": {"type": "Sentence", "linguistic_elements": [{"type": "Phrase", "linguistic_elements": [{"type": "Word"}]}]}}', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"A.": {"type": "Sentence"}}, 5, {"B.": 3}]', encoding="utf-8")
    rows = contract.contract_nodes(readers.contract_documents(spark, str(tmp_path))).collect()
    assert sorted(r["path"] for r in rows) == ["$.A.", "$.B.", "$.Hi.", "$.Hi..linguistic_elements[0]", "$.Hi..linguistic_elements[0].linguistic_elements[0]"]


def test_contract_errors_odd_documents(spark):
    rows = [(1, None), (2, "x"), (3, "{}"), (4, "[]"), (5, '{"a": null}'), (6, '{"a": {"linguistic_elements": [{"linguistic_elements": [{"linguistic_elements": [{"linguistic_elements": [{"linguistic_elements": [{}]}]}]}]}]}}')]
    df = spark.createDataFrame(rows, "doc_id long, contract string")
    got = {}
    for r in contract.errors(df, "v1").collect():
        got.setdefault(r["doc_id"], set()).add(r["message"])
    assert got[1] == got[2] == {"Top-level must be an object keyed by sentence content"} and 3 not in got and 4 not in got
    assert got[5] == {"Node must be an object"} and "nested deeper than 4" in got[6]
    assert contract.errors(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="validation_mode"):
        contract.errors(df, "v9")
    with pytest.raises(ValueError, match="Validation failed"):
        contract.raise_if_invalid(contract.errors(df))
    contract.raise_if_invalid(contract.errors(df.where("doc_id in (3, 4)")))


def test_several_files_first_wins_and_limits(spark, tmp_path):
    (tmp_path / "1.conllu").write_text("# text = A cat sat here.\n# text = Dogs ran away.\n", encoding="utf-8")
    (tmp_path / "2.conllu").write_text("# text = DOGS ran  away.\n# text = A third one came.\n", encoding="utf-8")
    paths = [str(tmp_path / "1.conllu"), str(tmp_path / "2.conllu")]
    assert [r["text"] for r in readers.conllu(spark, paths).orderBy("text").collect()] == ["A cat sat here.", "A third one came.", "Dogs ran away."]
    assert [r["text"] for r in readers.conllu(spark, paths, limit=2).orderBy("text").collect()] == ["A cat sat here.", "Dogs ran away."]
    (tmp_path / "t.tsv").write_text("1\teng\tThe first sentence.\n2\tdeu\tEin Satz hier.\n3\teng\tthe FIRST sentence.\nbad\n4\teng\tAnother sentence.\n", encoding="utf-8")
    assert {r["id"] for r in readers.tatoeba(spark, str(tmp_path / "t.tsv")).collect()} == {"1", "4"}
    assert {r["id"] for r in readers.tatoeba(spark, str(tmp_path / "t.tsv"), limit=1).collect()} == {"1"}
    (tmp_path / "f.xml").write_text("<description><![CDATA[<p>Hello there world. Second one here.</p>]]></description>", encoding="utf-8")
    assert readers.rss(spark, [str(tmp_path / "none.xml"), str(tmp_path / "f.xml")], limit=1).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.rss(spark, [str(tmp_path / "none.xml")])


def test_land_fetches_once(spark, tmp_path):
    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, timeout))
        return io.BytesIO("# text = Fetched sentence.\n".encode())

    path = readers.land(spark, "https://example.org/x", str(tmp_path / "x.conllu"), timeout=5, opener=opener)
    assert asked == [("https://example.org/x", 5)] and readers.conllu(spark, path).first()["text"] == "Fetched sentence."


def test_nested_report_and_regression(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"probe_count": 2, "eval_metrics": {"eval_exact_match": 0.5}, "aggregate": {"total_nodes": 9, "accepted_note_rate": "x"}}', encoding="utf-8")
    r = readers.nested_report(spark, str(tmp_path / "r.json"))
    got = {x["name"]: x["passed"] for x in ledger.regression_checks(r, r).collect()}
    assert len(got) == 8 and all(got.values())
    strict = {x["name"]: (x["passed"], x["overall_passed"]) for x in ledger.regression_checks(r, r, {"eval_exact_match": 0.1}).collect()}
    assert strict["train_eval_exact_match_non_regression"] == (False, False)


def test_extraction_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" plain text ", encoding="utf-8")
    (tmp_path / "b.wav").write_bytes(b"sound")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["kind"]: r for r in readers.extracted(files, {"audio": lambda raw: [(" one ", 0.0, 0.1), ("", 1, 2), ("two", 1.0, 3.0)]}).collect()}
    assert got["text"]["text"] == "plain text" and got["audio"]["text"] == "one two"
    assert [(s["start"], s["end"]) for s in got["audio"]["segments"]] == [(0.0, 0.2), (1.0, 3.0)]
    with pytest.raises(Exception, match="no transcript"):
        readers.extracted(files, {"audio": lambda raw: []}).collect()
    with pytest.raises(Exception, match="no extractor"):
        readers.extracted(files, {}).collect()


def test_sinks_count_migrate_and_stamp(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "z long, a string")
    assert writers.jsonl(df, str(tmp_path / "o"), sort_keys=True) == 2
    path = writers.stamped_json(df, str(tmp_path / "runs"), "2024-02-01T00:00:00Z")
    assert path.endswith("2024-02-01T00-00-00Z") and spark.read.json(path).count() == 2
    first = writers.ensure_schema(spark)
    assert first == [m for m, _ in writers.MIGRATIONS] and writers.ensure_schema(spark) == [] and spark.table("backend_jobs").count() == 0


def test_any_parser_makes_trees(spark):
    def make():
        def parse(text):
            words = text.split()
            at = [0]
            for w in words:
                at.append(at[-1] + len(w) + 1)
            pos = {"the": "DET", "cat": "NOUN", "sat": "VERB", "on": "ADP", "mats": "NOUN"}
            dep = {"the": "det", "cat": "nsubj", "sat": "ROOT", "on": "prep", "mats": "pobj"}
            head = {"the": 1, "cat": 2, "sat": 2, "on": 2, "mats": 3}
            chunk = {"the": 0, "cat": 0, "mats": 1}
            return [
                {"i": i, "w": w, "pos": pos[w], "tag": "", "dep": dep[w], "head": head[w], "start": at[i], "verb_form": "Fin" if w == "sat" else None, "tense_form": "Past" if w == "sat" else None, "chunk": chunk.get(w), "right_edge": 4 if w == "on" else i, "root": 2, "last": len(words) - 1}
                for i, w in enumerate(words)
            ]

        return parse

    df = spark.createDataFrame([(1, "the cat sat on mats"), (2, "")], "seq long, text string")
    tree = skeleton.trees(providers.parse(df, make)).orderBy("id").collect()
    assert [(r["id"], r["parent"], r["type"], r["content"], r["part_of_speech"]) for r in tree] == [
        (1, None, "Sentence", "the cat sat on mats", "sentence"), (2, 1, "Phrase", "sat", "verb phrase"), (3, 2, "Word", "sat", "verb"), (4, 1, "Phrase", "on mats", "prepositional phrase"), (5, 4, "Word", "on", "preposition"), (6, 4, "Word", "mats", "noun"),
        (7, 1, "Phrase", "mats", "noun phrase"), (8, 7, "Word", "mats", "noun"),
    ]
    assert (tree[0]["tense"], tree[0]["finiteness"]) == ("past", "finite") and tree[5]["head_id"] == 5 and tree[7]["ref"] == 6


def test_contract_backend_errors(spark):
    df = spark.createDataFrame([(0, "Hi.")], "sentence_idx int, sentence_text string")
    good = json.dumps({"sentence_node": {"type": "Sentence"}, "sentence_hash": "h"})
    assert providers.requested_contracts(df, lambda: lambda request: good).first()["sentence_node"] == '{"type": "Sentence"}'

    def down(request):
        raise OSError("no route")

    for client, message in ((down, "does not answer"), (lambda r: "{", "no JSON"), (lambda r: "[]", "no object"), (lambda r: '{"sentence_hash": 1}', "lacks")):
        with pytest.raises(Exception, match=message):
            providers.requested_contracts(df, lambda c=client: c).collect()


def test_generation_retries_and_translators(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    rows = {r["prompt"]: r for r in providers.generate(df, lambda: lambda p, sample: p.upper() if sample else "no", "prompt", lambda x: x == "A").collect()}
    assert rows["a"]["answer"] == "A" and rows["a"]["rejected"] == ["no"] and rows["b"]["answer"] is None and rows["b"]["rejected"] == ["no", "B", "B"]
    assert providers.resolve_translator(None)(" x ", "en", "ru") == "x" and providers.resolve_translator("unknown")("y", "en", "ru") == "y"
    with pytest.raises(RuntimeError, match="auth_key"):
        providers.resolve_translator("deepl", {})
    made = providers.resolve_translator("deepl", {"auth_key": "k"}, {"deepl": lambda auth_key: lambda t, s, g: f"{auth_key}:{t}"})
    assert made("z", "en", "ru") == "k:z"


def test_probe_texts(spark, tmp_path):
    assert ledger.probe_texts(spark).count() == 1
    (tmp_path / "p.json").write_text('["a", "b"]', encoding="utf-8")
    assert ledger.probe_texts(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "q.json").write_text('["a", 1]', encoding="utf-8")
    with pytest.raises(ValueError, match="array of strings"):
        ledger.probe_texts(spark, str(tmp_path / "q.json"))


def test_appended_ids_go_on(spark):
    state = spark.createDataFrame([(7, "x")], "id long, v string")
    batch = spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "o long, v string")
    got = ledger.appended(state, batch, "o").orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(7, "x"), (8, "a"), (9, "b"), (10, "c")]
    assert ledger.appended(state.where("false"), batch, "o").agg(F.min("id")).first()[0] == 1
