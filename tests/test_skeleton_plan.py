"""Plans of the trees and of emitted examples: what is shuffled, and how often the documents are read."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import annotate, emission, ledger, note_totals, notes, skeleton, tree_arrays
from lexloom.plans import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_deal_out_sentences_as_texts(spark):
    found = plan(skeleton.skeleton_trees(spark, SF))
    # Sentences are dealt out by number as texts, and no list of all numbers goes to the driver.
    assert "REPARTITION_BY_COL" in found and "LeftAnti, BuildRight, true" not in found


def test_examples_of_all_modes_read_the_documents_once(spark):
    for query in (emission.emitted_template_ids, emission.example_emission):
        assert plan(query(spark, SF)).count("Scan parquet") == 1


def test_equal_words_are_annotated_once(spark):
    rows = annotate.annotated_numbers(spark, SF, "two_stage").cache()
    words = rows.where("type = 'Word'")
    assert words.count() == words.select("toks").distinct().count()
    assert rows.agg(F.sum("n")).first()[0] == views.nodes(spark, SF).count()
    rows.unpersist()


def test_novelty_shuffles_sentences_not_notes(spark):
    found = plan(annotate.note_novelty_fold(spark, SF))
    assert found.count("Exchange") == 1 and "REPARTITION_BY_COL" in found


def test_words_sure_of_a_valid_note_have_one(spark):
    words = ("apple", "nodes", "'node", "don't", "node", "content", "sentence", "true", "'", "emphase", "contents", "phrase", "none", "short", "sensence")
    sound = annotate.sound_wordings()
    rows = [(t, w, t.replace("{content}", w)) for t in sorted({*annotate.WORD_NOTES.values(), *annotate.VERB_NOTES.values(), *annotate.ARTICLE_NOTES.values(), *annotate.PREPOSITION_NOTES.values(), annotate.WORD_OTHER}) for w in words]
    judged = notes.with_validity(spark.createDataFrame(rows, "wording string, content string, note string"), "note")
    sure = F.col("wording").isin(*sound) & ~notes.T.any_match("content", notes.BAD_INSIDE)
    found = judged.select("wording", "content", "note", "valid", sure.alias("sure")).collect()
    assert all(r["valid"] == r["sure"] for r in found if r["wording"] in sound)
    assert all(r["valid"] == notes.is_valid(r["note"]) for r in found)
    assert len(sound) > 20 and {r["valid"] for r in found} == {True, False}


def test_trees_sort_and_spill_no_words(spark):
    found = plan(skeleton.skeleton_trees(spark, SF))
    # Sentences are shuffled once, as texts; nothing is sorted, joined or aggregated.
    assert found.count("Exchange") == 1 and not any(x in found for x in ("Sort", "Join", "Aggregate", "Window"))


def test_trees_as_arrays_equal_those_of_rows(spark, tmp_path):
    words = ("the", "cat", "will", "not", "n't", "have", "being", "been", "seen", "walked", "walking", "was", "quickly", "of", "my", "and", "had", "should", "'", "is", "in", "house", "ing", "ed")
    pick = random.Random(1)
    texts = [" ".join(pick.choice(words) for _ in range(pick.choice((1, 2, 3, 5, 9, 30)))) for _ in range(600)]
    texts += [*words, "the cat", "the cat of", "was", "the house walked quickly. The . cat! ... My", "", "1 2 3", "Ünïted the cat ẞing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    want = {tuple(r) for r in skeleton.tree_digests(skeleton.trees(skeleton._parse(spark, str(tmp_path)))).collect()}
    assert {tuple(r) for r in skeleton.skeleton_trees(spark, str(tmp_path)).collect()} == want and len(want) > 600
    assert list(tree_arrays.slices(np.array([0, 3, 5, 50, 51]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_examples_are_totalled_without_their_texts(spark, tmp_path):
    words = ("before", "while", "because", "although", "the", "cat", "should", "have", "had", "being", "seen", "walking", "ing", "quickly", "of", "my", "and", "is", "'", "xing", "because")
    pick = random.Random(2)
    texts = [" ".join(pick.choice(words) for _ in range(pick.choice((1, 2, 3, 4, 5, 8, 9, 40)))) for _ in range(600)]
    texts += [*words, "Had. Should have! The cat? Had had", "", "1 2"]
    spark.createDataFrame(list(enumerate(texts, -20)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    e = emission.every_mode(spark, str(tmp_path))
    want = e.groupBy("mode", "level", "tam_bucket").agg(F.count("*"), F.countDistinct("target"), F.min(F.sha2(F.concat("input", F.lit("\n"), "target"), 256)))
    query = emission.example_emission(spark, str(tmp_path))
    # Neither prompts nor targets are shuffled, and nothing is sorted but a few totals.
    found = plan(query)
    assert "target#" not in found and found.count("Sort ") <= 2
    assert {tuple(r) for r in query.collect()} == {tuple(r) for r in want.collect()}


def test_notes_are_counted_without_their_rows(spark, tmp_path):
    words = ("before", "while", "although", "the", "cat", "should", "have", "had", "being", "seen", "walking", "ing", "quickly", "of", "my", "and", "is", "'", "'node", "node", "nodes", "content", "phrase", "sentence", "clause", "subordinate", "reason", "concession", "after", "none", "noun", "simple", "note", "with", "to", "don't", "short", "part", "verb", "an")
    pick = random.Random(3)
    texts = [". ".join(" ".join(pick.choice(words) for _ in range(pick.choice((1, 2, 3, 4, 5, 8, 9, 40)))) for _ in range(pick.choice((1, 3)))) for _ in range(900)]
    texts += [*words, "the cat. The cat", "a subordinate clause of reason the subordinate clause of", "before the reason. After a concession", "", "1 2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    a = annotate.annotated_numbers(spark, str(tmp_path), "two_stage", doc_id=F.floor(F.col("seq") / 100_000))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    want = a.groupBy("doc_id").agg(F.sum("n"), count(F.array_contains("quality_flags", "rule_used")), count(F.col("rejects") > 0), *[count(F.col("level") == x) for x in notes.LEVEL_NAMES], count(F.col("reason") == "tam_dropped"))
    got = ledger.note_probes(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("doc_id", *note_totals.FIELDS).collect()} == {tuple(r) for r in want.collect()}
    # Both sides of the report are counted in one reading of the documents, and no note is ranked or judged as a row.
    found = plan(ledger.regression_report(spark, SF))
    assert found.count("Scan parquet") == 1 and "Window" not in found
