"""Sinks: JSON lines, splits, tables, subtitles, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of the relational stores.
TABLES = {
    "runs": "run_id string, metadata string, created_at timestamp, updated_at timestamp",
    "sentences": "sentence_key string, run_id string, sentence_text string, source_lang string, target_lang string, language_pair string, contract_payload string, created_at timestamp, updated_at timestamp",
    "review_events": "id bigint, sentence_key string, reviewed_by string, change_reason string, confidence double, metadata string, created_at timestamp",
    "node_edits": "id bigint, review_event_id bigint, node_id string, field_path string, before_value string, after_value string, created_at timestamp",
    "backend_accounts": "id bigint, phone_hash string, created_at timestamp, updated_at timestamp",
}


def jsonl(df: DataFrame, path: str, sort_keys: bool = False, single: bool = False) -> int:
    """JSON lines; keys sorted if asked; one file only for small results.  Gives the number of rows, counted while they are written."""
    out = df.select(*sorted(df.columns)) if sort_keys else df
    seen = Observation()
    out = (out.coalesce(1) if single else out).observe(seen, F.count(F.lit(1)).alias("n"))
    out.write.mode("overwrite").json(path)
    return int(seen.get["n"])


def splits(df: DataFrame, path: str) -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def put_text(spark: SparkSession, path: str, body: str) -> None:
    """A small text file in the cluster's storage."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(body.encode("utf-8")))
    out.close()


def report(df: DataFrame, path: str) -> dict:
    """A one-row report as a JSON file; more rows are an error, none is an empty report."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a report has one row")
    out = rows[0].asDict(recursive=True) if rows else {}
    put_text(df.sparkSession, path, json.dumps(out, ensure_ascii=False, sort_keys=True, default=str))
    return out


def stamped_json(df: DataFrame, folder: str, now: str) -> str:
    """The rows as JSON lines in a folder named by the time given (ISO 8601), so runs stay apart."""
    path = f"{folder.rstrip('/')}/{now.replace(':', '-')}"
    jsonl(df, path)
    return path


#: Tables of the client's store.
CLIENT_TABLES = {
    "workspace_state": "key string, value string, updated_at timestamp",
    "projects": "id string, name string, created_at timestamp, updated_at timestamp",
    "media_files": "id string, project_id string, name string, path string, size_bytes bigint, duration_seconds int, created_at timestamp, updated_at timestamp",
    "documents": "id string, project_id string, media_file_id string, source_type string, source_path string, text_hash string, status string, created_at timestamp, updated_at timestamp",
    "document_text": "document_id string, full_text string, text_hash string, version int, updated_at timestamp",
    "media_sentences": "document_id string, sentence_idx int, sentence_text string, start_ms bigint, end_ms bigint, page_no int, char_start int, char_end int, sentence_hash string",
    "contract_sentences": "document_id string, sentence_hash string, sentence_node string, updated_at timestamp",
    "sentence_link": "document_id string, sentence_idx int, sentence_hash string",
    "local_edits": "id bigint, sentence_key string, node_id string, field_path string, before_value string, after_value string, created_at timestamp",
    "backend_jobs": "id string, media_file_id string, status string, request_payload string, created_at timestamp, updated_at timestamp",
    "sync_requests": "id string, kind string, payload string, status string, created_at timestamp, updated_at timestamp",
}
#: Migrations in the order of their numbers: what each adds.
MIGRATIONS = (("0001_runs_and_sentences", ("runs", "sentences")), ("0002_accounts", ("backend_accounts",)), ("0003_reviews", ("review_events", "node_edits")), ("0004_client", tuple(CLIENT_TABLES)))


def ensure_schema(spark: SparkSession) -> list[str]:
    """Apply the migrations that the ledger table does not name, in order; gives the names of those applied."""
    spark.sql("CREATE TABLE IF NOT EXISTS schema_migrations (name string) USING parquet")
    known = {r["name"] for r in spark.table("schema_migrations").collect()}  # one row a migration
    done, every = [], TABLES | CLIENT_TABLES
    for name, tables in MIGRATIONS:
        if name in known:
            continue
        for t in tables:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {t} ({every[t]}) USING parquet")
        spark.createDataFrame([(name,)], "name string").write.mode("append").insertInto("schema_migrations")
        done.append(name)
    return done


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Only the partitions that df has are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def text_files(df: DataFrame, path: str, key: str, body: str) -> None:
    """A text artifact per document, in a folder of its key."""
    df.select(key, F.col(body).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
