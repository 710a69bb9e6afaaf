"""Scans: line, JSON, CoNLL-U, TSV, RSS and contract sources, source specs, directories, as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import text

FORMATS = ("jsonl", "json", "txt")
#: Kinds of media by suffix.
MEDIA = {"pdf": ("pdf",), "audio": ("mp3", "wav", "m4a", "flac", "ogg"), "video": ("mp4", "mkv", "mov", "avi", "webm")}
CONTRACT = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("rejected_candidates", T.ArrayType(T.StringType()))]))


@dataclass(frozen=True)
class SourceSpec:
    """A licensed source of sentences."""

    name: str
    input_path: str
    source_url: str
    license: str
    attribution_required: bool = True
    quota: int = 0
    format: str = "jsonl"
    text_field: str = "text"
    id_prefix: str = ""


def specs(path: str) -> list[SourceSpec]:
    """Specs of a small JSON file; an empty list is an error, and so is an unknown format."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f).get("sources", [])
    if not rows:
        raise ValueError("no sources in the configuration")
    found = [SourceSpec(**r) for r in rows]
    for s in found:
        if s.format not in FORMATS:
            raise ValueError(f"unsupported source format: {s.format}")
    return found


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, within each file), value: a line's index counts blank lines.

    Lines take their order from where Spark read them; ranks are within a file, one task per file part at most.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return raw.select("file", (F.row_number().over(W.Window.partitionBy("file").orderBy("at")) - 1).alias("line"), "value")


def rows_of(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """id, text of a source by its format."""
    prefix = spec.id_prefix or spec.name
    default = F.format_string(prefix.replace("%", "%%") + "_%07d", F.col("line"))
    if spec.format == "txt":
        lines = numbered_lines(spark, spec.input_path).where(F.trim("value") != "")
        return lines.select(default.alias("id"), F.trim("value").alias("text"))
    if spec.format == "jsonl":
        lines = numbered_lines(spark, spec.input_path).where(F.trim("value") != "")
    else:
        whole = spark.read.text(spec.input_path, wholetext=True)
        lines = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("line", "value"))
    own = F.get_json_object("value", "$.id")
    return lines.select(F.coalesce(own, default).alias("id"), F.get_json_object("value", f"$.{spec.text_field}").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines with a schema; a missing file is an error, or an empty relation."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """key, type, content, rejected_candidates: the sentences of contract documents."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", CONTRACT).alias("doc"))
    return docs.select(F.explode("doc").alias("key", "node")).select("key", "node.*")


def contract_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file), contract (its JSON text): an object of sentences, or a list of such objects; `operators.contract` explodes them."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("contract"))


def _in_order(spark: SparkSession, paths: str | list[str], read) -> DataFrame:
    """Rows of all paths with `seq`: by path, then by place."""
    parts = [read(p).withColumn("seq", F.struct(F.lit(k).alias("path"), F.monotonically_increasing_id().alias("at"))) for k, p in enumerate([paths] if isinstance(paths, str) else paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _distinct(rows: DataFrame, limit: int | None, *more: str) -> DataFrame:
    """The first of each text, whatever its case and spaces, in order; the first `limit` of these where a source asks for so many."""
    first = rows.groupBy(text.norm_key("text").alias("key")).agg(F.min_by(F.struct("text", *more), "seq").alias("one"), F.min("seq").alias("seq"))
    first = first.orderBy("seq").limit(limit) if limit is not None else first
    return first.select("one.*")


def conllu(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Distinct sentences of the `# text = ` lines of one or several files, earlier files first."""
    read = lambda p: spark.read.text(p).where(F.startswith("value", F.lit("# text = "))).select(F.trim(F.substring("value", 10, 1 << 30)).alias("text"))
    return _distinct(_in_order(spark, paths, read).where(text.looks_like_sentence("text")), limit)


def tatoeba(spark: SparkSession, path: str, lang: str = "eng", limit: int | None = None) -> DataFrame:
    """Distinct sentences of one language of a (compressed) id, language, text table; malformed rows go."""
    read = lambda p: spark.read.csv(p, sep="\t", schema="id string, lang string, text string", mode="DROPMALFORMED", quote="")
    rows = _in_order(spark, path, read).where((F.col("lang") == lang) & text.looks_like_sentence("text"))
    return _distinct(rows, limit, "id").select("id", "text")


def rss(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Distinct sentences of the descriptions of a feed, without markup; of several paths the first that is there counts."""
    found = next((p for p in ([paths] if isinstance(paths, str) else paths) if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"no feed at {paths}")
    bodies = spark.read.text(found, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("(?is)<description>(.*?)</description>"), 1)).alias("body"))
    parts = bodies.select(F.explode(text.sentence_parts(text.strip_html("body"))).alias("text"))
    return _distinct(_in_order(spark, "", lambda _: parts).where(text.looks_like_sentence("text")), limit)


def land(spark: SparkSession, url: str, path: str, headers: dict[str, str] | None = None, timeout: int = 30, opener=urlopen) -> str:
    """Fetch a URL once, on the driver, into a path of the cluster's storage; the scans above read it from there."""
    with opener(Request(url, headers=headers or {"User-Agent": "Mozilla/5.0"}), timeout=timeout) as answer:
        body = answer.read()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(body))
    out.close()
    return path


def nested_report(spark: SparkSession, path: str) -> DataFrame:
    """One row of a report: its probe count and the figures of `eval_metrics` and `aggregate`, as columns of text; a missing figure is null."""
    names = ("eval_exact_match", "eval_loss"), ("total_nodes", "accepted_note_rate", "fallback_rate", "rejected_nodes_total", "semantic_mismatch_rate")
    raw = spark.read.text(path, wholetext=True)
    figure = lambda p, n: F.get_json_object("value", f"$.{p}").alias(n)
    return raw.select(figure("probe_count", "probe_count"), *[figure(f"{o}.{n}", n) for o, ns in zip(("eval_metrics", "aggregate"), names) for n in ns])


def directory(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, bytes of a folder's files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def media_kind(path):
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    out = F.lit("text")
    for kind, suffixes in MEDIA.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def hard_negative_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern rows of a list, or of a list under the key `patterns`; none for a missing file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "pattern string")
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.patterns"), "array<string>"), F.from_json("value", "array<string>"))
    return raw.select(F.explode(listed).alias("pattern"))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, low: int = 0, high: int = 0) -> DataFrame:
    """A table of a relational store, read in `parts` ranges of a key where one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and parts > 1:
        r = r.option("partitionColumn", key).option("numPartitions", parts).option("lowerBound", low).option("upperBound", high)
    return r.load()


def extracted(files: DataFrame, extractors: dict[str, object]) -> DataFrame:
    """path, kind, text, segments of binary files(path, content): by kind an extractor (bytes to text, or to timed segments).

    `extractors` maps a kind to a function bytes -> str | list of (text, start, end); texts need none.  A segment lasts
    0.2 s at least; a transcript without text is an error, and so is a kind without an extractor.  One file is one row of a task.
    """
    schema = "path string, kind string, text string, segments array<struct<text:string,start:double,end:double>>"

    def run(batches):
        for rows in batches:
            out = []
            for path, kind, content in zip(rows["path"], rows["kind"], rows["content"]):
                if kind == "text" and kind not in extractors:
                    out.append((path, kind, bytes(content).decode("utf-8", "ignore").strip(), []))
                    continue
                if kind not in extractors:
                    raise RuntimeError(f"no extractor for {kind} files")
                found = extractors[kind](bytes(content))
                if isinstance(found, str):
                    out.append((path, kind, found.strip(), []))
                    continue
                timed = [(t.strip(), float(a), max(float(b), float(a) + 0.2)) for t, a, b in found if t.strip()]
                if not timed:
                    raise RuntimeError(f"no transcript in {path}")
                out.append((path, kind, " ".join(t for t, _, _ in timed), [{"text": t, "start": a, "end": b} for t, a, b in timed]))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "segments"])

    return files.select("path", media_kind(F.col("path")).alias("kind"), "content").mapInPandas(run, schema)
