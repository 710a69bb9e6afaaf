"""Providers: hooks for parsers and models, with deterministic defaults.  A provider is called once per distinct input."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def enrich(df: DataFrame, keys: list[str], provider: Callable[[pd.DataFrame], pd.Series], name: str) -> DataFrame:
    """df with the provider's answer for its keys: asked over distinct keys in batches, then joined back."""
    asked = df.select(*keys).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{name: provider(rows)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + f", `{name}` string"
    return df.join(asked.mapInPandas(run, schema), keys, "left")


def parse(df: DataFrame, make_parser: Callable[[], Callable[[str], list[dict]]], text: str = "text", keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Token rows of a text column by any parser: (keys, i, w, pos, tag, dep, head, start, verb_form, tense_form, chunk, right_edge, root, last).

    make_parser is called once in each task (a model is loaded there); the parser gives a dict for each token of a text.
    """
    fields = "i int, w string, pos string, tag string, dep string, head int, start int, verb_form string, tense_form string, chunk long, right_edge int, root int, last int"
    names = [f.split()[0] for f in fields.split(", ")]
    rows = df.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + ", " + fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        for part in batches:
            out = [(*k, *(token.get(n) for n in names)) for *k, t in part.itertuples(index=False) for token in parser(t or "")]
            yield pd.DataFrame(out, columns=[*keys, *names]).astype(object)

    return rows.mapInPandas(run, schema)


class ContractBackendError(RuntimeError):
    """A backend that makes contracts was not there, or gave no contract."""


def requested_contracts(df: DataFrame, make_client: Callable[[], Callable[[dict], str]], keys: tuple[str, ...] = ("sentence_idx", "sentence_text")) -> DataFrame:
    """keys, sentence_node, sentence_hash (JSON, text) of each sentence as a backend answers: `make_client` gives a function from a request to the answer's text, made once in each task.

    Errors: the backend does not answer; the answer is no JSON; it is no object; it lacks the node or the hash.
    """
    rows = df.select(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sentence_node string, sentence_hash string"

    def answer(client: Callable[[dict], str], request: dict) -> tuple[str, str]:
        try:
            raw = client(request)
        except (OSError, TimeoutError) as problem:
            raise ContractBackendError("the backend does not answer") from problem
        try:
            found = json.loads(raw)
        except json.JSONDecodeError as problem:
            raise ContractBackendError("the answer is no JSON") from problem
        if not isinstance(found, dict):
            raise ContractBackendError("the answer is no object")
        if "sentence_node" not in found or "sentence_hash" not in found:
            raise ContractBackendError("the answer lacks the node or its hash")
        return json.dumps(found["sentence_node"], ensure_ascii=False, sort_keys=True), str(found["sentence_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in batches:
            answers = [answer(client, dict(zip(keys, row))) for row in part.itertuples(index=False)]
            yield part.assign(sentence_node=[a for a, _ in answers], sentence_hash=[b for _, b in answers])

    return rows.mapInPandas(run, schema)


def generate(df: DataFrame, make_model: Callable[[], Callable[[str, bool], str]], prompt: str, accept: Callable[[str], bool], attempts: int = 3) -> DataFrame:
    """df with `answer` and `rejected`: a model is asked up to `attempts` times, first without sampling, until an answer is accepted; the others are kept as rejected."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", answer string, rejected array<string>"

    def ask(model: Callable[[str, bool], str], text: str) -> tuple[str | None, list[str]]:
        refused = []
        for k in range(attempts):
            found = model(text, k > 0)
            if accept(found):
                return found, refused
            refused.append(found)
        return None, refused

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for part in batches:
            answers = [ask(model, t) for t in part[prompt]]
            yield part.assign(answer=[a for a, _ in answers], rejected=[r for _, r in answers])

    return df.mapInPandas(run, schema)


#: Providers of translations by name, and the credentials that each needs; others fall back on the text itself.
TRANSLATORS = {"gpt": ("api_key",), "deepl": ("auth_key",), "lara": ("api_id", "api_secret")}


def resolve_translator(name: str | None, credentials: dict[str, str] | None = None, makers: dict[str, Callable[..., Callable[[str, str, str], str]]] | None = None) -> Callable[[str, str, str], str]:
    """A translator (text, source, target) by its provider's name; missing credentials are an error, an unknown provider or one that cannot be made gives the text itself."""
    echo = lambda text, source, target: (text or "").strip()
    name = (name or "echo").strip().lower()
    needed, given = TRANSLATORS.get(name, ()), credentials or {}
    if any(not str(given.get(k) or "").strip() for k in needed):
        raise RuntimeError(f"the provider {name} needs {', '.join(needed)}")
    make = (makers or {}).get(name)
    if make is None:
        return echo
    try:
        return make(**{k: given[k] for k in needed})
    except Exception:  # noqa: BLE001
        return echo
