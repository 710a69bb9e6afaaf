"""Contracts as JSON: nested documents to node rows, every node rule as rows of errors, frozen structure, level corpora.

A contract maps a sentence's text to its tree.  Nodes are kept as VARIANT, so a rule sees the type that a field
has in the JSON (a number is no string, a JSON null is no missing field).  One projection takes the kinds and
values that the rules need out of a node; the rules then are plain conditions on these columns, the same text for
Spark and for the SQL that checks it.  Rules on lists work on one row for each item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans import views as V
from .store import CEFR_LEVELS

#: Fields that a node needs, in either mode and in strict mode.
REQUIRED = ("content", "linguistic_elements", "linguistic_notes", "part_of_speech", "tense", "type")
STRICT_REQUIRED = ("grammatical_role", "node_id", "schema_version", "source_span")
#: Node types, kinds and sources of notes, modes.
NODE_TYPES = ("Sentence", "Phrase", "Word")
NOTE_KINDS = ("semantic", "syntactic", "morphological", "discourse")
NOTE_SOURCES = ("model", "rule", "fallback")
MODES = ("v1", "v2_strict")
#: Fields that freezing compares.
FROZEN = ("type", "content", "part_of_speech", "node_id", "parent_id", "source_span", "grammatical_role", "dep_label", "head_id", "features", "schema_version")
#: Fields of a template selection that are strings or null; counters of back-off; lists of strings.
SELECTION = ("level", "template_id", "matched_key", "registry_version", "context_key_l1", "context_key_l2", "context_key_l3", "context_key_matched", "selection_mode")
COUNTERS = ("backoff_nodes_count", "backoff_leaf_nodes_count", "backoff_aggregate_nodes_count", "backoff_unique_spans_count")
TRACES = ("quality_flags", "rejected_candidates", "reason_codes")
SUMMARY_LISTS = ("nodes", "leaf_nodes", "unique_spans", "reasons")
VERBAL = ("aspect", "mood", "voice", "finiteness")

_FIELDS = (
    *REQUIRED, *STRICT_REQUIRED, "source_span.start", "source_span.end", "dep_label", "head_id", "parent_id", *VERBAL, "tam_construction", "features", "notes",
    "translation", *(f"translation.{k}" for k in ("source_lang", "target_lang", "text", "model")), "phonetic", "phonetic.uk", "phonetic.us", "synonyms", "cefr_level", *TRACES,
    "template_selection", *(f"template_selection.{k}" for k in SELECTION), "template_selection.matched_level_reason", "backoff_in_subtree", *COUNTERS,
    "backoff_summary", *(f"backoff_summary.{k}" for k in SUMMARY_LISTS), "backoff_summary.aggregate_nodes_count", "rejected_candidate_stats",
)
_NUMBERS = ("source_span.start", "source_span.end", *COUNTERS, "backoff_summary.aggregate_nodes_count")
_LISTS = ("notes", "synonyms", *TRACES, "rejected_candidate_stats", "linguistic_notes", *(f"backoff_summary.{k}" for k in SUMMARY_LISTS))
_ITEM_FIELDS = ("text", "kind", "confidence", "source", "count", "reasons")


def _c(field: str) -> str:
    return field.replace(".", "__")


def kind(v: Column) -> Column:
    """string, int, float, bool, null, list or object; SQL null where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string").when(s == "BIGINT", "int").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").when(s.isNotNull(), "float")
    )


def _get(v: Column | str, path: str, to: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", to)


def contract_nodes(contracts: DataFrame, levels: int = 4) -> DataFrame:
    """Rows (doc_id, key, path, place, depth, node, top, up_type, up_id) of contracts(doc_id, contract: JSON text).

    A contract is an object, or a list of objects, of trees; nodes that are no objects are rows too.  `levels` is
    how deep trees are followed (a sentence is level 0); what lies deeper is reported by `errors`, not dropped in silence.
    """
    v = contracts.select("doc_id", F.try_parse_json("contract").alias("v"))
    whole = kind(F.col("v"))
    entries = F.when(whole == "object", F.map_entries(_get("v", "", "map<string,variant>"))).when(whole == "list", F.flatten(F.transform(_get("v", "", "array<variant>"), lambda x: F.map_entries(F.coalesce(_get(x, "", "map<string,variant>"), F.create_map().cast("map<string,variant>"))))))
    tops = v.select("doc_id", F.inline(entries).alias("key", "node"))
    none = F.lit(None).cast("string")
    level = tops.select("doc_id", "key", F.concat(F.lit("$."), "key").alias("path"), F.array().cast("array<int>").alias("place"), F.lit(0).alias("depth"), "node", none.alias("up_type"), none.alias("up_id"))
    out = level
    for depth in range(1, levels + 1):
        below = level.select("doc_id", "key", F.col("path").alias("_path"), F.col("place").alias("_place"), _get("node", "type", "string").alias("up_type"), _get("node", "node_id", "string").alias("up_id"), F.posexplode(_get("node", "linguistic_elements", "array<variant>")).alias("i", "node"))
        level = below.select("doc_id", "key", F.concat("_path", F.lit(".linguistic_elements["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.concat("_place", F.array("i")).alias("place"), F.lit(depth).alias("depth"), "node", "up_type", "up_id")
        out = out.unionByName(level)
    return out


def described(nodes: DataFrame) -> DataFrame:
    """The columns that the rules are written in: k_ kinds, t_ texts, n_ numbers, and what needs the children."""
    node = F.col("node")
    columns = [kind(_get(node, f)).alias(f"k_{_c(f)}") for f in _FIELDS]
    columns += [_get(node, f, "string").alias(f"t_{_c(f)}") for f in _FIELDS]
    columns += [_get(node, f, "bigint").alias(f"n_{_c(f)}") for f in _NUMBERS]
    flags = lambda v: F.coalesce(F.array_contains(_get(v, "quality_flags", "array<string>"), "backoff_used"), F.lit(False))
    children = _get(node, "linguistic_elements", "array<variant>")
    signal = F.coalesce(F.exists(children, lambda c: flags(c) | F.coalesce(_get(c, "backoff_in_subtree", "boolean"), F.lit(False))), F.lit(False))
    columns += [flags(node).alias("has_backoff"), signal.alias("child_signal"), F.coalesce(F.size(children), F.lit(0)).alias("n_children"), F.coalesce(F.size(_get(node, "synonyms", "array<variant>")), F.lit(0)).alias("n_synonyms")]
    return nodes.select("doc_id", "key", "path", "place", "depth", "up_type", "up_id", "node", kind(node).alias("k_node"), *columns)


def items(nodes: DataFrame) -> DataFrame:
    """One row for each item of a node's lists: doc_id, path, field, i, k_item, t_item and the kinds and texts of its fields; the reasons of statistics count as lists too."""
    lists = F.array(*[F.struct(F.lit(f).alias("field"), _get("node", f, "array<variant>").alias("xs")) for f in _LISTS])
    each = nodes.select("doc_id", "path", F.inline(lists)).select("doc_id", "path", "field", F.posexplode("xs").alias("i", "item"))
    reasons = each.where("field = 'rejected_candidate_stats'").select("doc_id", "path", F.concat(F.lit("rejected_candidate_stats["), F.col("i").cast("string"), F.lit("].reasons")).alias("field"), F.posexplode(_get("item", "reasons", "array<variant>")).alias("i", "item"))
    every = each.unionByName(reasons)
    item = F.col("item")
    return every.select("doc_id", "path", "field", "i", kind(item).alias("k_item"), _get(item, "", "string").alias("t_item"), *[kind(_get(item, f)).alias(f"k_{f}") for f in _ITEM_FIELDS], *[_get(item, f, "string").alias(f"t_{f}") for f in ("kind", "source")], _get(item, "confidence", "double").alias("n_confidence"), _get(item, "count", "bigint").alias("n_count"))


def features(nodes: DataFrame) -> DataFrame:
    """One row for each feature: doc_id, path, name, k_item, t_item."""
    entries = nodes.select("doc_id", "path", F.explode(_get("node", "features", "map<string,variant>")).alias("name", "item"))
    return entries.select("doc_id", "path", "name", kind(F.col("item")).alias("k_item"), _get("item", "", "string").alias("t_item"))


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def node_rules(strict: bool) -> list[tuple[str, str, str]]:
    """(path below the node, message, condition that it is broken).  Fixed values: the messages."""
    k, t = (lambda f: f"k_{_c(f)}"), (lambda f: f"t_{_c(f)}")
    rules: list[tuple[str, str, str]] = [
        (".type", "Invalid node type", f"coalesce({k('type')} <> 'string' OR {t('type')} NOT IN ({_quoted(NODE_TYPES)}), true)"),
        (".content", "content must be string", f"coalesce({k('content')} <> 'string', true)"),
        (".part_of_speech", "part_of_speech must be string", f"coalesce({k('part_of_speech')} <> 'string', true)"),
        (".source_span", "source_span must be an object", f"{k('source_span')} <> 'object'"),
        (".source_span.start", "start must be integer", f"{k('source_span')} = 'object' AND coalesce({k('source_span.start')} NOT IN ('int', 'bool'), true)"),
        (".source_span.end", "end must be integer", f"{k('source_span')} = 'object' AND coalesce({k('source_span.end')} NOT IN ('int', 'bool'), true)"),
        (".source_span.start", "start must be >= 0", f"{k('source_span.start')} = 'int' AND {k('source_span.end')} = 'int' AND n_source_span__start < 0"),
        (".source_span.end", "end must be >= start", f"{k('source_span.start')} = 'int' AND {k('source_span.end')} = 'int' AND n_source_span__end < n_source_span__start"),
        (".grammatical_role", "grammatical_role must be string", f"{k('grammatical_role')} <> 'string'"),
        (".dep_label", "dep_label must be string", f"{k('dep_label')} <> 'string'"),
        (".head_id", "head_id must be string or null", f"{k('head_id')} NOT IN ('string', 'null')"),
        (".head_id", "head_id must not equal node_id", f"{k('head_id')} = 'string' AND {k('node_id')} = 'string' AND {t('head_id')} = {t('node_id')}"),
        (".tam_construction", "tam_construction must be string", f"{k('tam_construction')} <> 'string'"),
        (".tam_construction", "tam_construction must be non-empty string", f"{k('tam_construction')} = 'string' AND trim({t('tam_construction')}) = ''"),
        (".features", "features must be object", f"{k('features')} <> 'object'"),
        (".notes", "notes must be list", f"{k('notes')} <> 'list'"),
        (".translation", "translation must be object", f"{k('translation')} <> 'object'"),
        (".translation.model", "model must be string", f"{k('translation')} = 'object' AND {k('translation.model')} NOT IN ('string', 'null')"),
        (".translation.model", "model must be non-empty", f"{k('translation.model')} = 'string' AND trim({t('translation.model')}) = ''"),
        (".phonetic", "phonetic must be object", f"{k('phonetic')} <> 'object'"),
        (".synonyms", "synonyms must be list", f"{k('synonyms')} <> 'list'"),
        (".synonyms", "content words must have non-empty synonyms", f"{k('synonyms')} = 'list' AND trim({t('type')}) = 'Word' AND lower(trim({t('part_of_speech')})) IN ('noun', 'verb', 'adjective', 'adverb') AND n_synonyms = 0"),
        (".cefr_level", "cefr_level must be string", f"{k('cefr_level')} <> 'string'"),
        (".cefr_level", "cefr_level must be one of A1|A2|B1|B2|C1|C2", f"{k('cefr_level')} = 'string' AND upper(trim({t('cefr_level')})) NOT IN ({_quoted(CEFR_LEVELS)})"),
        (".schema_version", "schema_version must be string", f"{k('schema_version')} <> 'string'"),
        (".schema_version", "schema_version must be non-empty", f"{k('schema_version')} = 'string' AND trim({t('schema_version')}) = ''"),
        (".node_id", "node_id must be string", f"{k('node_id')} <> 'string'"),
        (".parent_id", "parent_id must be string or null", f"{k('parent_id')} NOT IN ('string', 'null')"),
        (".parent_id", "Sentence parent_id must be null", f"{k('parent_id')} <> 'null' AND up_id IS NULL"),
        (".parent_id", "parent_id mismatch", f"{k('parent_id')} IS NOT NULL AND up_id IS NOT NULL AND coalesce({k('parent_id')} <> 'string' OR {t('parent_id')} <> up_id, true)"),
        (".linguistic_notes", "linguistic_notes must be list", f"coalesce({k('linguistic_notes')} <> 'list', true)"),
        (".linguistic_elements", "linguistic_elements must be list", f"coalesce({k('linguistic_elements')} <> 'list', true)"),
        (".linguistic_elements", "Word must have empty linguistic_elements", f"{t('type')} = 'Word' AND {k('linguistic_elements')} = 'list' AND n_children > 0"),
        (".type", "Sentence can only contain Phrase or Word", f"up_type = 'Sentence' AND coalesce({t('type')} NOT IN ('Phrase', 'Word'), true)"),
        (".type", "Phrase can only contain Phrase or Word", f"up_type = 'Phrase' AND coalesce({t('type')} NOT IN ('Phrase', 'Word'), true)"),
        (".type", "Top-level value must be Sentence", f"depth = 0 AND coalesce({t('type')} <> 'Sentence', true)"),
        (".content", "Sentence content must match top-level key", f"depth = 0 AND coalesce({t('content')} <> key, true)"),
        (".template_selection", "template_selection must be object", f"{k('template_selection')} <> 'object'"),
        (".template_selection.matched_level_reason", "matched_level_reason must be string", f"{k('template_selection.matched_level_reason')} NOT IN ('string', 'null')"),
        (".template_selection.level", "matched_level_reason='tam_dropped' requires level='L2_DROP_TAM'", f"{k('template_selection.matched_level_reason')} = 'string' AND {t('template_selection.matched_level_reason')} = 'tam_dropped' AND upper(coalesce({t('template_selection.level')}, '')) <> 'L2_DROP_TAM'"),
        (".template_selection.matched_level_reason", "matched_level_reason='tam_dropped' is only allowed for TAM-relevant nodes", f"{k('template_selection.matched_level_reason')} = 'string' AND {t('template_selection.matched_level_reason')} = 'tam_dropped' AND NOT (lower(trim(coalesce({t('type')}, ''))) = 'sentence' OR lower(trim(coalesce({t('part_of_speech')}, ''))) IN ('verb phrase', 'clause', 'verb', 'auxiliary verb') OR lower(trim(coalesce({t('tam_construction')}, ''))) NOT IN ('', 'none', 'null'))"),
        (".quality_flags", "backoff_used is required when template_selection.level is not L1_EXACT", f"{k('template_selection')} = 'object' AND {k('quality_flags')} = 'list' AND NOT has_backoff AND upper(coalesce({t('template_selection.level')}, '')) NOT IN ('', 'L1_EXACT')"),
        (".quality_flags", "backoff_used is not allowed when template_selection.level is L1_EXACT", f"{k('template_selection')} = 'object' AND {k('quality_flags')} = 'list' AND has_backoff AND upper({t('template_selection.level')}) = 'L1_EXACT'"),
        (".backoff_in_subtree", "backoff_in_subtree must be boolean", f"{k('backoff_in_subtree')} <> 'bool'"),
        (".backoff_in_subtree", "backoff_in_subtree=true requires at least one descendant backoff signal", f"{k('backoff_in_subtree')} = 'bool' AND {t('backoff_in_subtree')} = 'true' AND {k('linguistic_elements')} = 'list' AND NOT child_signal"),
        (".backoff_in_subtree", "backoff_in_subtree=false is inconsistent with descendant backoff signals", f"{k('backoff_in_subtree')} = 'bool' AND {t('backoff_in_subtree')} = 'false' AND {k('linguistic_elements')} = 'list' AND child_signal"),
        (".backoff_unique_spans_count", "backoff_unique_spans_count must be <= backoff_leaf_nodes_count", f"{k('backoff_leaf_nodes_count')} = 'int' AND {k('backoff_unique_spans_count')} = 'int' AND n_backoff_unique_spans_count > n_backoff_leaf_nodes_count"),
        (".backoff_aggregate_nodes_count", "backoff_nodes_count must equal backoff_leaf_nodes_count + backoff_aggregate_nodes_count", f"{k('backoff_nodes_count')} = 'int' AND {k('backoff_leaf_nodes_count')} = 'int' AND {k('backoff_aggregate_nodes_count')} = 'int' AND n_backoff_nodes_count <> n_backoff_leaf_nodes_count + n_backoff_aggregate_nodes_count"),
        (".backoff_summary", "backoff_summary must be object", f"{k('backoff_summary')} <> 'object'"),
        (".backoff_summary.aggregate_nodes_count", "aggregate_nodes_count must be integer", f"{k('backoff_summary.aggregate_nodes_count')} NOT IN ('int', 'bool', 'null')"),
        (".backoff_summary.aggregate_nodes_count", "aggregate_nodes_count must be >= 0", f"{k('backoff_summary.aggregate_nodes_count')} = 'int' AND n_backoff_summary__aggregate_nodes_count < 0"),
        (".rejected_candidate_stats", "rejected_candidate_stats must be list", f"{k('rejected_candidate_stats')} <> 'list'"),
    ]
    rules += [(f".{f}", f"{f} must be list", f"{k(f)} <> 'list'") for f in TRACES]
    rules += [(f".{o}.{f}", f"{f} must be string", f"{k(o)} = 'object' AND coalesce({k(f'{o}.{f}')} <> 'string', true)") for o, fs in (("translation", ("source_lang", "target_lang", "text")), ("phonetic", ("uk", "us"))) for f in fs]
    rules += [(f".{o}.{f}", f"{f} must be non-empty", f"{k(f'{o}.{f}')} = 'string' AND trim({t(f'{o}.{f}')}) = ''") for o, fs in (("translation", ("source_lang", "target_lang", "text")), ("phonetic", ("uk", "us"))) for f in fs]
    rules += [(f".template_selection.{f}", f"{f} must be string or null", f"{k(f'template_selection.{f}')} NOT IN ('string', 'null')") for f in SELECTION]
    for f in COUNTERS:
        rules += [(f".{f}", f"{f} must be integer", f"{k(f)} NOT IN ('int', 'bool')"), (f".{f}", f"{f} must be >= 0", f"{k(f)} = 'int' AND n_{f} < 0")]
    for f in SUMMARY_LISTS:
        needed = "coalesce({0} <> 'list', true)" if f in ("nodes", "reasons") else "{0} NOT IN ('list', 'null')"
        rules.append((f".backoff_summary.{f}", f"{f} must be list", f"{k('backoff_summary')} = 'object' AND " + needed.format(k(f"backoff_summary.{f}"))))
    if strict:
        rules += [(f".{f}", f"{f} must be string or null in strict mode", f"{k(f)} NOT IN ('string', 'null')") for f in ("tense", *VERBAL)]
        rules += [(f".{f}", f"{f} must use real null, not string 'null', in strict mode", f"{k(f)} = 'string' AND lower({t(f)}) = 'null'") for f in ("tense", *VERBAL)]
        no_tense = f"coalesce({k('tense')} = 'null', true)"
        perfect = f"{k('tam_construction')} = 'string' AND {t('tam_construction')} = 'modal_perfect'"
        rules += [
            (".mood", "modal_perfect requires mood='modal'", f"{perfect} AND coalesce({t('mood')} <> 'modal', true)"),
            (".aspect", "modal_perfect requires aspect='perfect'", f"{perfect} AND coalesce({t('aspect')} <> 'perfect', true)"),
            (".tense", "modal_perfect requires tense=null in strict mode", f"{perfect} AND NOT {no_tense}"),
            (".tam_construction", "modal mood + perfect aspect + tense null requires tam_construction='modal_perfect' in strict mode", f"{t('mood')} = 'modal' AND {t('aspect')} = 'perfect' AND {no_tense} AND coalesce({t('tam_construction')} <> 'modal_perfect', true)"),
            (".translation.model", "translation.model is required for Sentence in strict mode", f"{k('translation')} = 'object' AND {t('type')} = 'Sentence' AND coalesce({k('translation.model')} <> 'string' OR trim({t('translation.model')}) = '', true)"),
            (".schema_version", "schema_version must be 'v2' in strict mode", f"coalesce({k('schema_version')} <> 'string' OR {t('schema_version')} <> 'v2', true)"),
        ]
    else:
        rules.append((".tense", "tense must be string", f"coalesce({k('tense')} <> 'string', true)"))
        rules += [(f".{f}", f"{f} must be string", f"{k(f)} <> 'string'") for f in VERBAL]
    return rules


def missing_fields(strict: bool) -> str:
    """The names of missing fields as the message lists them."""
    names = sorted((*REQUIRED, *STRICT_REQUIRED) if strict else REQUIRED)
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN k_{n} IS NULL THEN '''{n}''' END" for n in names) + ")"


#: (field or its pattern, path below the item, message, condition).  Fixed values: the messages.
ITEM_RULES = (
    ("field = 'notes'", "", "note item must be object", "k_item <> 'object'"),
    ("field = 'notes'", ".text", "text must be string", "k_item = 'object' AND coalesce(k_text <> 'string', true)"),
    ("field = 'notes'", ".kind", "kind must be one of semantic|syntactic|morphological|discourse", f"k_item = 'object' AND coalesce(k_kind <> 'string' OR t_kind NOT IN ({_quoted(NOTE_KINDS)}), true)"),
    ("field = 'notes'", ".confidence", "confidence must be number", "k_item = 'object' AND coalesce(k_confidence NOT IN ('int', 'float', 'bool'), true)"),
    ("field = 'notes'", ".confidence", "confidence must be in range [0, 1]", "k_confidence IN ('int', 'float') AND NOT n_confidence BETWEEN 0 AND 1"),
    ("field = 'notes'", ".source", "source must be one of model|rule|fallback", f"k_item = 'object' AND coalesce(k_source <> 'string' OR t_source NOT IN ({_quoted(NOTE_SOURCES)}), true)"),
    ("field = 'synonyms'", "", "synonym item must be string", "k_item <> 'string'"),
    ("field = 'synonyms'", "", "synonym item must be non-empty", "k_item = 'string' AND trim(t_item) = ''"),
    ("field = 'linguistic_notes'", "", "note must be string", "k_item <> 'string'"),
    *((f"field = '{f}'", "", f"{f} items must be string", "k_item <> 'string'") for f in TRACES),
    *((f"field = 'backoff_summary.{f}'", "", m, "k_item <> 'string'") for f, m in zip(SUMMARY_LISTS, ("node id must be string", "node id must be string", "span key must be string", "reason must be string"))),
    ("field = 'rejected_candidate_stats'", "", "stats item must be object", "k_item <> 'object'"),
    ("field = 'rejected_candidate_stats'", ".text", "text must be string", "k_item = 'object' AND coalesce(k_text <> 'string', true)"),
    ("field = 'rejected_candidate_stats'", ".count", "count must be integer", "k_item = 'object' AND coalesce(k_count NOT IN ('int', 'bool'), true)"),
    ("field = 'rejected_candidate_stats'", ".count", "count must be >= 1", "k_count = 'int' AND n_count < 1"),
    ("field = 'rejected_candidate_stats'", ".reasons", "reasons must be list", "k_item = 'object' AND coalesce(k_reasons <> 'list', true)"),
    ("field LIKE 'rejected_candidate_stats[%].reasons'", "", "reason must be string", "k_item <> 'string'"),
)
_FEATURE_RULES = {
    True: (("feature values must be string or null in strict mode", "k_item NOT IN ('string', 'null')"), ("feature values must use real null, not string 'null', in strict mode", "k_item = 'string' AND lower(t_item) = 'null'")),
    False: (("feature values must be string", "k_item <> 'string'"),),
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spark_text(value: str) -> str:
    return '"' + value + '"'


def errors(contracts: DataFrame, mode: str = "v2_strict", levels: int = 4) -> DataFrame:
    """Rows (doc_id, path, message): every broken rule of contracts(doc_id, contract).

    Null contracts and texts that are no JSON give the row `$`; empty contracts none.  Nodes deeper than `levels` give a row each.
    """
    if mode not in MODES:
        raise ValueError("validation_mode must be v1 or v2_strict")
    strict = mode == "v2_strict"
    every = described(contract_nodes(contracts, levels))
    nodes = every.where("k_node = 'object'")
    rule = lambda path, message, broken: F.when(F.expr(broken), F.struct(F.lit(path).alias("below"), F.lit(message).alias("message")))
    missing = F.expr(missing_fields(strict))
    found = [rule(*r) for r in node_rules(strict)] + [F.when(missing != "", F.struct(F.lit("").alias("below"), F.concat(F.lit("Missing required fields: ["), missing, F.lit("]")).alias("message")))]
    deeper = F.when((F.col("depth") == levels) & (F.col("n_children") > 0), F.struct(F.lit(".linguistic_elements").alias("below"), F.lit(f"nested deeper than {levels}").alias("message")))
    rows = nodes.select("doc_id", "path", F.inline(F.array_compact(F.array(*found, deeper)))).select("doc_id", F.concat("path", "below").alias("path"), "message")
    parts = items(nodes)
    of_items = F.array_compact(F.array(*[rule(below, message, f"{on} AND {broken}") for on, below, message, broken in ITEM_RULES]))
    at = F.concat("path", F.lit("."), "field", F.lit("["), F.col("i").cast("string"), F.lit("]"))
    rows = rows.unionByName(parts.select("doc_id", at.alias("path"), F.inline(of_items)).select("doc_id", F.concat("path", "below").alias("path"), "message"))
    same = F.lower(F.trim(F.regexp_replace("t_item", r"\s+", " ")))
    again = F.row_number().over(W.Window.partitionBy("doc_id", "path", same).orderBy("i")) > 1
    words = parts.where((F.col("field") == "synonyms") & (F.col("k_item") == "string") & (same != "")).withColumn("again", again)
    rows = rows.unionByName(words.where("again").select("doc_id", at.alias("path"), F.lit("synonym items must be unique").alias("message")))
    of_features = F.array_compact(F.array(*[F.when(F.expr(broken), F.lit(message)) for message, broken in _FEATURE_RULES[strict]]))
    rows = rows.unionByName(features(nodes).select("doc_id", F.concat("path", F.lit(".features."), "name").alias("path"), F.explode(of_features).alias("message")))
    # The first of nodes with one id, in the order of keys and places, keeps it.
    ids = nodes.where("k_node_id = 'string'").withColumn("again", F.row_number().over(W.Window.partitionBy("doc_id", "t_node_id").orderBy("key", "place")) > 1)
    rows = rows.unionByName(ids.where("again").select("doc_id", F.concat("path", F.lit(".node_id")).alias("path"), F.lit("node_id must be unique").alias("message")))
    rows = rows.unionByName(every.where("k_node <> 'object'").select("doc_id", "path", F.lit("Node must be an object").alias("message")))
    whole = kind(F.try_parse_json("contract"))
    return rows.unionByName(contracts.where(F.coalesce(~whole.isin("object", "list"), F.lit(True))).select("doc_id", F.lit("$").alias("path"), F.lit("Top-level must be an object keyed by sentence content").alias("message")))


def raise_if_invalid(found: DataFrame, shown: int = 20) -> None:
    """ValueError with the first errors; the driver sees no more than it shows."""
    rows = found.orderBy("doc_id", "path", "message").limit(shown).collect()
    if rows:
        raise ValueError("Validation failed:\n" + "\n".join(f"- {r['path']}: {r['message']}" for r in rows))


def frozen_errors(base: DataFrame, other: DataFrame, levels: int = 4) -> DataFrame:
    """Rows (doc_id, path, message) where contracts differ in frozen fields, in the number of children, or in their keys (then only that).

    A node whose number of children changed is not followed further.
    """
    def rows(df: DataFrame, name: str) -> DataFrame:
        n = contract_nodes(df, levels).select("doc_id", "key", "path", *[F.to_json(_get("node", f)).alias(f) for f in FROZEN], F.coalesce(F.size(_get("node", "linguistic_elements", "array<variant>")), F.lit(0)).alias("n_children"), F.lit(True).alias("there"))
        return n.select(*["doc_id", "key", "path"], F.struct(*FROZEN, "n_children", "there").alias(name))

    j = rows(base, "b").join(rows(other, "o"), ["doc_id", "key", "path"], "full_outer")
    top = F.col("path") == F.concat(F.lit("$."), "key")
    keys = j.where(top & (F.col("b").isNull() | F.col("o").isNull())).select("doc_id").distinct()
    cut = j.where(F.col("b.n_children") != F.col("o.n_children")).select("doc_id", F.col("path").alias("cut"))
    both = j.join(keys, "doc_id", "left_anti").where(F.col("b").isNotNull() & F.col("o").isNotNull())
    # A node below a cut has it as a proper ancestor: the paths above a node are few, one for each level.
    above = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda n: F.regexp_replace(F.col("path"), F.concat(F.lit(r"(\.linguistic_elements\[\d+\]){"), n.cast("string"), F.lit("}$")), ""))
    up = both.select("doc_id", "path", F.explode(F.array_distinct(F.filter(above, lambda p: p != F.col("path")))).alias("cut")).join(cut, ["doc_id", "cut"]).select("doc_id", "path").distinct()
    reached = both.join(up, ["doc_id", "path"], "left_anti")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"o.{f}")), F.struct(F.lit(f".{f}").alias("below"), F.lit("Frozen field mismatch").alias("message"))) for f in FROZEN], F.when(F.col("b.n_children") != F.col("o.n_children"), F.struct(F.lit(".linguistic_elements").alias("below"), F.lit("Children count mismatch").alias("message")))))
    out = reached.select("doc_id", "path", F.inline(changed)).select("doc_id", F.concat("path", "below").alias("path"), "message")
    return out.unionByName(keys.select("doc_id", F.lit("$").alias("path"), F.lit("Top-level sentence keys mismatch").alias("message")))


# --- fixtures: trees with a fault each, one for each conversation turn

_OK = '"tense":null,"linguistic_notes":["a note"],"grammatical_role":"unknown","schema_version":"v2"'


def _node(kind_: str, content: str, pos: str, ids: str, children: str = "", more: str = "", ok: str = _OK) -> str:
    return f'{{"type":"{kind_}","content":"{content}","part_of_speech":"{pos}",{ids},{ok},"source_span":{{"start":0,"end":4}},"linguistic_elements":[{children}]{more}}}'


def _tree(sentence: str = "", phrase: str = "", word: str = "", ok: str = _OK, word_ids: str = '"node_id":"n3","parent_id":"n2"', word_children: str = "") -> str:
    w = _node("Word", "she", "noun", word_ids, word_children, word, ok)
    p = _node("Phrase", "she left", "verb phrase", '"node_id":"n2","parent_id":"n1"', w, phrase)
    return '{"{key}":' + _node("Sentence", "{key}", "sentence", '"node_id":"n1","parent_id":null', p, sentence) + "}"


_W = '"node_id":"n4","parent_id":"n3"'
FIXTURES = (
    _tree(), "[]", "{}", "no json", "[1, {}]", '{"{key}":7}', "[" + _tree() + "," + _tree() + "]",
    _tree(ok=_OK.replace('"tense":null,', "")), _tree(ok=_OK.replace('"schema_version":"v2"', '"schema_version":"v1"')), _tree(ok=_OK.replace('"schema_version":"v2"', '"schema_version":" "')), _tree(ok=_OK.replace("null", '"NULL"')), _tree(ok=_OK.replace("null", "3")),
    _tree(ok=_OK.replace('["a note"]', '"a note"')), _tree(ok=_OK.replace('["a note"]', '["a", 1, null]')), _tree(ok=_OK.replace('"unknown"', "5")),
    _tree(word_ids='"node_id":"n2","parent_id":"n2"'), _tree(word_ids='"node_id":"n3","parent_id":"n9"'), _tree(word_ids='"node_id":3,"parent_id":4'), _tree(word_ids='"node_id":"n3"'), _tree(word_children=_node("Word", "x", "noun", _W)), _tree(word_children=_node("Sentence", "x", "noun", _W)),
    _tree(phrase=',"dep_label":1,"head_id":"n2"'), _tree(phrase=',"head_id":["x"]'), _tree(phrase=',"aspect":"null","mood":1,"voice":"active"'), _tree(phrase=',"tam_construction":" "'), _tree(phrase=',"tam_construction":2'), _tree(phrase=',"tam_construction":"modal_perfect","mood":"modal"'),
    _tree(phrase=',"mood":"modal","aspect":"perfect"'), _tree(phrase=',"mood":"modal","aspect":"perfect","tam_construction":"modal_perfect"'), _tree(phrase=',"features":{"a":"x","b":null,"c":"null","d":4}'), _tree(phrase=',"features":[1]'),
    _tree(word=',"notes":{}'), _tree(word=',"notes":[1,{"text":"t","kind":"semantic","confidence":0.5,"source":"rule"},{"text":2,"kind":"odd","confidence":1.5,"source":"x"},{"confidence":"0.5"}]'),
    _tree(sentence=',"translation":{"source_lang":"en","target_lang":"ru","text":"x"}'), _tree(sentence=',"translation":{"source_lang":"","target_lang":5,"model":" "}'), _tree(word=',"translation":"x"'), _tree(word=',"translation":{"source_lang":"en","target_lang":"ru","text":"x","model":3}'),
    _tree(word=',"phonetic":{"uk":"a"}'), _tree(word=',"phonetic":{"uk":" ","us":"b"}'), _tree(word=',"phonetic":null'), _tree(word=',"synonyms":[]'), _tree(word=',"synonyms":["Go","go ","",5,"left"]'), _tree(word=',"synonyms":"go"'), _tree(phrase=',"synonyms":[]'),
    _tree(word=',"cefr_level":"b2 "'), _tree(word=',"cefr_level":"D1"'), _tree(word=',"cefr_level":4'), _tree(word=',"quality_flags":"x","rejected_candidates":["a",1],"reason_codes":[null]'),
    _tree(phrase=',"quality_flags":[],"template_selection":{"level":"L2_DROP_TAM","matched_level_reason":"tam_dropped"}'), _tree(word=',"quality_flags":["backoff_used"],"template_selection":{"level":"L3_LEVEL_POS","matched_level_reason":"tam_dropped"}'), _tree(word=',"quality_flags":["backoff_used"],"template_selection":{"level":"L1_EXACT","template_id":5,"matched_key":null}'),
    _tree(word=',"template_selection":3'), _tree(word=',"template_selection":{"matched_level_reason":7,"context_key_l1":[]}'), _tree(phrase=',"backoff_in_subtree":true'), _tree(phrase=',"backoff_in_subtree":false', word=',"quality_flags":["backoff_used"]'), _tree(phrase=',"backoff_in_subtree":true', word=',"quality_flags":["backoff_used"]'), _tree(sentence=',"backoff_in_subtree":"yes"'),
    _tree(sentence=',"backoff_nodes_count":3,"backoff_leaf_nodes_count":1,"backoff_aggregate_nodes_count":1,"backoff_unique_spans_count":2'), _tree(sentence=',"backoff_nodes_count":-1,"backoff_leaf_nodes_count":"1","backoff_unique_spans_count":0.5'),
    _tree(sentence=',"backoff_summary":{"nodes":["n1",2],"reasons":["r"]}'), _tree(sentence=',"backoff_summary":{"leaf_nodes":"x","unique_spans":[1],"aggregate_nodes_count":-2,"reasons":[3]}'), _tree(sentence=',"backoff_summary":{"nodes":[],"reasons":[],"leaf_nodes":[],"aggregate_nodes_count":"2","unique_spans":null}'), _tree(sentence=',"backoff_summary":[]'),
    _tree(phrase=',"rejected_candidate_stats":[{"text":"a","count":1,"reasons":["r",2]},{"text":1,"count":0,"reasons":"x"},{"count":"1"},4]'), _tree(phrase=',"rejected_candidate_stats":{}'),
    _tree(ok=_OK + ',"linguistic_elements":5').replace(',"linguistic_elements":[]', "", 1), _tree().replace('"content":"{key}"', '"content":"other"'), _tree().replace('"type":"Phrase"', '"type":"Clause"'), _tree().replace('"part_of_speech":"noun",', ""), _tree().replace('{"start":0,"end":4}', '{"start":-1,"end":"4"}'), _tree().replace('{"start":0,"end":4}', '{"start":5,"end":4}'), _tree().replace('{"start":0,"end":4}', "[0, 4]"), _tree().replace('"content":"she"', '"content":4'),
)


def contracts(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """doc_id, contract: a tree for each conversation turn, with one of the faults or none."""
    c = V.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"))
    k = F.pmod(F.col("doc_id") + shift, F.lit(len(FIXTURES))).cast("int")
    return c.select("doc_id", F.replace(F.get(F.array(*[F.lit(x) for x in FIXTURES]), k), F.lit("{key}"), F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("contract"))


def contract_errors_strict(spark: SparkSession, sf: str) -> DataFrame:
    return errors(contracts(spark, sf), "v2_strict")


def contract_errors_v1(spark: SparkSession, sf: str) -> DataFrame:
    return errors(contracts(spark, sf), "v1")


def contract_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Nested contracts as node rows, in pre-order of places."""
    n = described(contract_nodes(contracts(spark, sf)))
    return n.select("doc_id", "path", "depth", F.array_join(F.transform("place", lambda x: x.cast("string")), "/").alias("place"), "k_node", F.col("t_type").alias("type"), F.col("t_node_id").alias("node_id"), "up_id")


def frozen_contract_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each contract against another of the same key: changed fields, changed numbers of children, other keys."""
    return frozen_errors(contracts(spark, sf), contracts(spark, sf, 1))


def level_corpus_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of a corpus of trees (a list, one document each): type and level of every node; entries that are no objects."""
    n = described(contract_nodes(contracts(spark, sf)))
    at = F.replace("path", F.concat(F.lit("$."), "key"), F.lit("[0]"))
    shown = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    level = F.col("t_cefr_level")
    kind_ = F.coalesce(F.when(F.col("k_type") == "string", F.col("t_type")), F.lit(""))
    found = F.array_compact(F.array(
        F.when(F.col("k_node") != "object", F.struct(at.alias("path"), F.lit("sentence entry must be object").alias("message"))),
        F.when((F.col("k_node") == "object") & ~kind_.isin(*NODE_TYPES), F.struct(at.alias("path"), F.concat(F.lit("unexpected node type: "), shown(kind_)).alias("message"))),
        F.when((F.col("k_node") == "object") & F.coalesce(F.col("k_cefr_level") != "string", F.lit(True)), F.struct(F.concat(at, F.lit(".cefr_level")).alias("path"), F.lit("missing cefr_level").alias("message"))),
        F.when((F.col("k_cefr_level") == "string") & ~F.upper(F.trim(level)).isin(*CEFR_LEVELS), F.struct(F.concat(at, F.lit(".cefr_level")).alias("path"), F.concat(F.lit("invalid cefr_level "), shown(level), F.lit("; expected one of A1|A2|B1|B2|C1|C2")).alias("message"))),
    ))
    return n.select("doc_id", F.inline(found)).groupBy("path", "message").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


QUERIES = {f.__name__: f for f in (contract_errors_strict, contract_errors_v1, contract_explode, frozen_contract_diff, level_corpus_issues)}


# --- the same in SQL

def _sql_kind(value: str) -> str:
    return f"CASE json_type({value}) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END"


def _sql_at(value: str, path: str) -> str:
    return f"json_extract({value}, '$.{path}')"


def _sql_contracts(name: str, shift: int = 0) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text(x)}" for i, x in enumerate(FIXTURES))
    return f"""{name}0 AS (SELECT conv_id * 1000 + turn AS doc_id FROM conversations), {name}1 AS (SELECT doc_id, replace(CASE (doc_id + {shift}) % {len(FIXTURES)} {cases} END, '{{key}}', 'c' || doc_id) AS raw FROM {name}0),
{name} AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS contract FROM {name}1),
{name}_e AS (SELECT doc_id, contract AS e FROM {name} WHERE json_type(contract) = 'OBJECT' UNION ALL SELECT doc_id, unnest(json_extract(contract, '$[*]')) AS e FROM {name} WHERE json_type(contract) = 'ARRAY'),
{name}_k AS (SELECT doc_id, e, unnest(json_keys(e)) AS key FROM {name}_e WHERE json_type(e) = 'OBJECT')"""


def _sql_nodes(name: str, source: str) -> str:
    return f"""{name}(doc_id, key, path, place, depth, up_type, up_id, node) AS (SELECT doc_id, key, '$.' || key, []::INTEGER[], 0, NULL::VARCHAR, NULL::VARCHAR, json_extract(e, '$."' || key || '"') FROM {source}_k
  UNION ALL SELECT n.doc_id, n.key, n.path || '.linguistic_elements[' || i || ']', n.place || [CAST(i AS INTEGER)], n.depth + 1, json_extract_string(n.node, '$.type'), json_extract_string(n.node, '$.node_id'), json_extract(n.node, '$.linguistic_elements[' || i || ']')
  FROM {name} n, unnest(range(CASE WHEN json_type(n.node, '$.linguistic_elements') = 'ARRAY' THEN CAST(json_array_length(n.node, '$.linguistic_elements') AS BIGINT) ELSE 0 END)) t(i))"""


def _sql_text(value: str) -> str:
    return f"CASE WHEN json_type({value}) NOT IN ('NULL', 'ARRAY', 'OBJECT') THEN json_extract_string({value}, '$') END"


def _sql_list(value: str) -> str:
    return f"CASE WHEN json_type({value}) = 'ARRAY' THEN json_extract({value}, '$[*]') ELSE []::JSON[] END"


_FLAGS = "coalesce(list_contains(list_transform({}, lambda x: json_extract_string(x, '$')), 'backoff_used'), false)"
_CHILD = f"({_FLAGS.format(_sql_list(_sql_at('c', 'quality_flags')))} OR coalesce(json_extract_string(c, '$.backoff_in_subtree') = 'true', false))"
_DESCRIBED = (
    "d AS MATERIALIZED (SELECT doc_id, key, path, place, depth, up_type, up_id, node, " + _sql_kind("node") + " AS k_node, "
    + ", ".join(f"{_sql_kind(_sql_at('node', f))} AS k_{_c(f)}, {_sql_text(_sql_at('node', f))} AS t_{_c(f)}" for f in _FIELDS) + ", "
    + ", ".join(f"TRY_CAST({_sql_text(_sql_at('node', f))} AS BIGINT) AS n_{_c(f)}" for f in _NUMBERS)
    + f", {_FLAGS.format(_sql_list(_sql_at('node', 'quality_flags')))} AS has_backoff, len(list_filter({_sql_list(_sql_at('node', 'linguistic_elements'))}, lambda c: {_CHILD})) > 0 AS child_signal"
    + f", len({_sql_list(_sql_at('node', 'linguistic_elements'))}) AS n_children, len({_sql_list(_sql_at('node', 'synonyms'))}) AS n_synonyms FROM n), o AS MATERIALIZED (SELECT * FROM d WHERE k_node = 'object')"
)
_ITEMS = (
    "i0 AS (" + " UNION ALL ".join(f"SELECT doc_id, path, '{f}' AS field, unnest({_sql_list(_sql_at('node', f))}) AS item, unnest(range(len({_sql_list(_sql_at('node', f))}))) AS i FROM o" for f in _LISTS) + "), "
    + f"i1 AS (SELECT * FROM i0 UNION ALL SELECT doc_id, path, 'rejected_candidate_stats[' || i || '].reasons', unnest({_sql_list(_sql_at('item', 'reasons'))}), unnest(range(len({_sql_list(_sql_at('item', 'reasons'))}))) FROM i0 WHERE field = 'rejected_candidate_stats'), "
    + f"it AS MATERIALIZED (SELECT doc_id, path, field, i, {_sql_kind('item')} AS k_item, {_sql_text('item')} AS t_item, " + ", ".join(f"{_sql_kind(_sql_at('item', f))} AS k_{f}" for f in _ITEM_FIELDS)
    + f", {_sql_text(_sql_at('item', 'kind'))} AS t_kind, {_sql_text(_sql_at('item', 'source'))} AS t_source, TRY_CAST({_sql_text(_sql_at('item', 'confidence'))} AS DOUBLE) AS n_confidence, TRY_CAST({_sql_text(_sql_at('item', 'count'))} AS BIGINT) AS n_count FROM i1)"
)


def _sql_errors(strict: bool) -> str:
    parts = [f"SELECT doc_id, path || '{p}' AS path, {_text(m)} AS message FROM o WHERE {b}" for p, m, b in node_rules(strict)]
    parts.append(f"SELECT doc_id, path, 'Missing required fields: [' || {missing_fields(strict)} || ']' FROM o WHERE {missing_fields(strict)} <> ''")
    parts += [f"SELECT doc_id, path || '.' || field || '[' || i || ']' || '{below}', {_text(m)} FROM it WHERE {on} AND {b}" for on, below, m, b in ITEM_RULES]
    same = r"lower(trim(regexp_replace(t_item, '\s+', ' ', 'g')))"
    parts.append(f"SELECT doc_id, path || '.synonyms[' || i || ']', 'synonym items must be unique' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path, {same} ORDER BY i) AS r FROM it WHERE field = 'synonyms' AND k_item = 'string' AND {same} <> '') WHERE r > 1")
    parts += [f"SELECT doc_id, path || '.features.' || name, {_text(m)} FROM ft WHERE {b}" for m, b in _FEATURE_RULES[strict]]
    parts.append("SELECT doc_id, path || '.node_id', 'node_id must be unique' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, t_node_id ORDER BY key, place) AS r FROM o WHERE k_node_id = 'string') WHERE r > 1")
    parts += ["SELECT doc_id, path, 'Node must be an object' FROM d WHERE k_node <> 'object'", "SELECT doc_id, '$', 'Top-level must be an object keyed by sentence content' FROM c WHERE coalesce(json_type(contract) NOT IN ('OBJECT', 'ARRAY'), true)"]
    ft = f"f0 AS (SELECT doc_id, path, node, unnest(json_keys(node, '$.features')) AS name FROM o WHERE k_features = 'object'), f1 AS (SELECT doc_id, path, name, json_extract(node, '$.features.\"' || name || '\"') AS item FROM f0), ft AS (SELECT doc_id, path, name, {_sql_kind('item')} AS k_item, {_sql_text('item')} AS t_item FROM f1)"
    return f"WITH RECURSIVE {_sql_contracts('c')}, {_sql_nodes('n', 'c')}, {_DESCRIBED}, {_ITEMS}, {ft} " + " UNION ALL ".join(parts)


def _sql_frozen() -> str:
    fields = ", ".join(f"json_extract(node, '$.{f}') AS {f}" for f in FROZEN)
    rows = lambda n: f"SELECT doc_id, key, path, depth, {fields}, len({_sql_list(_sql_at('node', 'linguistic_elements'))}) AS n_children FROM {n}"
    parts = [f"SELECT doc_id, path || '.{f}' AS path, 'Frozen field mismatch' AS message FROM r WHERE b_{f} IS DISTINCT FROM o_{f}" for f in FROZEN]
    return (
        f"WITH RECURSIVE {_sql_contracts('c')}, {_sql_contracts('x', 1)}, {_sql_nodes('n', 'c')}, {_sql_nodes('m', 'x')}, b AS ({rows('n')}), o AS ({rows('m')}), "
        + "keys AS (SELECT DISTINCT coalesce(b.doc_id, o.doc_id) AS doc_id FROM (SELECT * FROM b WHERE depth = 0) b FULL JOIN (SELECT * FROM o WHERE depth = 0) o ON b.doc_id = o.doc_id AND b.path = o.path WHERE b.path IS NULL OR o.path IS NULL), "
        + "j AS (SELECT b.doc_id, b.path, b.n_children AS bn, o.n_children AS bo, " + ", ".join(f"b.{f} AS b_{f}, o.{f} AS o_{f}" for f in FROZEN) + " FROM b JOIN o ON b.doc_id = o.doc_id AND b.key = o.key AND b.path = o.path WHERE b.doc_id NOT IN (SELECT doc_id FROM keys)), "
        + "r AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM j a WHERE a.doc_id = j.doc_id AND a.bn <> a.bo AND starts_with(j.path, a.path || '.linguistic_elements['))) "
        + " UNION ALL ".join([*parts, "SELECT doc_id, path || '.linguistic_elements', 'Children count mismatch' FROM r WHERE bn <> bo", "SELECT doc_id, '$', 'Top-level sentence keys mismatch' FROM keys"])
    )


_AT = "replace(path, '$.' || key, '[0]')"
_TYPE = "CASE WHEN k_type = 'string' THEN t_type ELSE '' END"
ORACLES = {
    "contract_errors_strict": _sql_errors(True),
    "contract_errors_v1": _sql_errors(False),
    "contract_explode": f"WITH RECURSIVE {_sql_contracts('c')}, {_sql_nodes('n', 'c')} SELECT doc_id, path, depth, array_to_string(place, '/') AS place, {_sql_kind('node')} AS k_node, json_extract_string(node, '$.type') AS type, {_sql_text(_sql_at('node', 'node_id'))} AS node_id, up_id FROM n",
    "frozen_contract_diff": _sql_frozen(),
    "level_corpus_issues": f"""WITH RECURSIVE {_sql_contracts('c')}, {_sql_nodes('n', 'c')}, {_DESCRIBED}, x AS (SELECT doc_id, {_AT} AS path, 'sentence entry must be object' AS message FROM d WHERE k_node <> 'object'
      UNION ALL SELECT doc_id, {_AT}, 'unexpected node type: ''' || {_TYPE} || '''' FROM o WHERE {_TYPE} NOT IN ({_quoted(NODE_TYPES)}) UNION ALL SELECT doc_id, {_AT} || '.cefr_level', 'missing cefr_level' FROM o WHERE coalesce(k_cefr_level <> 'string', true)
      UNION ALL SELECT doc_id, {_AT} || '.cefr_level', 'invalid cefr_level ''' || t_cefr_level || '''; expected one of A1|A2|B1|B2|C1|C2' FROM o WHERE k_cefr_level = 'string' AND upper(trim(t_cefr_level)) NOT IN ({_quoted(CEFR_LEVELS)}))
      SELECT path, message, count(*) AS n, min(doc_id) AS first_doc FROM x GROUP BY 1, 2""",
}
