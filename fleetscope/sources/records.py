"""Record tables: scans, decoding, flush, expiry, tables with keys, export.

All functions are lazy DataFrame to DataFrame; range and equality filters stay plain column comparisons so that they
reach the Parquet scan and its partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import fixed
from fleetscope.functions.scalars import rows_of


def scan_window(records: DataFrame, kind: str, as_of: int, seconds: int = 900, client_id: str | None = None,
                pid: int | None = None) -> DataFrame:
    """Records of one cadence in the closed range [as_of - seconds, as_of], in time order."""
    x = records.where((F.col("type") == kind) & F.col("t").between(as_of - seconds, as_of))
    if client_id is not None:
        x = x.where(F.col("client_id") == client_id)
    if pid is not None:
        x = x.where(F.col("pid") == pid)
    return x.orderBy("client_id", "pid", "t")


def scan_both_cadences(records: DataFrame, as_of: int, seconds: int = 900) -> DataFrame:
    """Both cadences in one pass over the table, tagged by their type."""
    return records.where(F.col("type").isin("1s", "5s") & F.col("t").between(as_of - seconds, as_of))


def decode_json_records(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """Decode JSON values; rows that do not parse keep a NULL value and ``malformed`` = true."""
    x = raw.withColumn("_v", F.try_parse_json(text))
    return x.withColumns({"record": F.when(F.col("_v").isNotNull(), F.from_json(text, schema)), "malformed": F.col("_v").isNull()}).drop("_v")


def scan_key_prefix(entries: DataFrame, prefix: str, now: int, key: str = "key", expires: str = "expires_at") -> DataFrame:
    """Entries whose key starts with the prefix and that have not expired (no expiry time means never)."""
    return entries.where(F.col(key).startswith(prefix) & (F.col(expires).isNull() | (F.col(expires) > now)))


def lookup_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of the wanted keys; keys without a row are left out. The planner broadcasts the key side while it is small."""
    return table.join(keys.select(on).distinct(), on, "left_semi")


def flush_latest_wins(batch: DataFrame, types: Sequence[str] = ("1s", "5s"), key: Sequence[str] = ("client_id", "pid", "type", "t")) -> DataFrame:
    """Records of the given types with a pid; per key the last write (largest ``seq``) wins.

    max_by per column keeps this a hash aggregate with map-side combine: one row per key leaves each task.
    """
    rest = [c for c in batch.columns if c not in key and c != "seq"]
    x = batch.where(F.col("type").isin(*types) & F.col("pid").isNotNull())
    return x.groupBy(*key).agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in rest])


def ttl_expire(records: DataFrame, now: int, ttl: int = fixed.RECORD_TTL) -> DataFrame:
    return records.where(F.col("t") > now - ttl)


def table_filter(table: DataFrame, **equal) -> DataFrame:
    """Conjunctive equality filter; None asks for NULL."""
    for c, v in equal.items():
        table = table.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return table


def page_with_total(table: DataFrame, order: Sequence[str | Column], page: int = 1, page_size: int = 10) -> DataFrame:
    """One page in the given order, with page number, size and the total row count on every row."""
    total = table.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = table.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows.withColumns({"total": total, "page": F.lit(page), "page_size": F.lit(page_size)})


def upsert_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key; keys of ``new`` are unique."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def partial_update(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Given (non-null) fields of the patch overwrite, all others stay."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    return old.join(p, key, "left").select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def delete_by_source(chunks: DataFrame, sources: DataFrame, key: str = "source_key") -> DataFrame:
    """Drop all chunks of the given sources, by exact key."""
    return chunks.join(sources.select(key).distinct(), key, "left_anti")


STORAGE_SCHEMA = ("EventName string, Records array<struct<s3:struct<bucket:struct<name:string>,"
                  "object:struct<key:string,size:bigint,contentType:string,eTag:string>>>>")


def explode_storage_events(events: DataFrame, body: str = "body") -> DataFrame:
    """Upload notices of an object store to one row per uploaded file."""
    e = events.select("*", F.from_json(body, STORAGE_SCHEMA).alias("e")).where("e.EventName = 's3:ObjectCreated:Put'")
    r = rows_of(e, [c for c in events.columns if c != body], "e.Records", "r")
    x = r.withColumn("key", F.url_decode("r.s3.object.key"))
    base = F.regexp_extract("key", r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    size = F.col("r.s3.object.size")
    return x.select(
        *[c for c in events.columns if c != body], F.col("r.s3.bucket.name").alias("bucket"), "key", size.alias("size"),
        F.col("r.s3.object.eTag").alias("etag"), F.regexp_extract(base, r".\.([^.]*)$", 1).alias("filetype"),
        F.when(stem.contains("_"), F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)).otherwise(stem).alias("filename"),
        F.round(size / 1024 / 1024, 2).alias("size_mb"))


def ingest_new_only(files: DataFrame, registered: DataFrame, etag: str = "etag", order: str = "doc_id") -> DataFrame:
    """Files whose content is not registered yet, each content once (the first by ``order``)."""
    rest = [c for c in files.columns if c != etag]
    once = files.groupBy(etag).agg(*[F.min_by(c, order).alias(c) for c in rest])
    return once.join(registered.select(etag).distinct(), etag, "left_anti")


def safe_name(namespace: str | Column, prefix: str = "vs_") -> Column:
    c = F.col(namespace) if isinstance(namespace, str) else namespace
    return F.concat(F.lit(prefix), F.regexp_replace(c, r"[^a-zA-Z0-9]", "_"))


def crash_file_scan(files: DataFrame, instances: DataFrame) -> DataFrame:
    """New core files joined to their instance; unknown processes and a different program path are rejected.

    files: parsed names (``crash_text.core_filename``). Meta side files are no core files.
    """
    f = files.where("filename like 'core%' and filename not like '%.meta.json' and filename not like '%.context.json'")
    i = instances.select("pid", F.col("exe_path").alias("known_path"))
    return f.join(i, "pid", "left").withColumn("decision", F.expr(
        "case when known_path is null then 'unknown process' when known_path <> exe_path then 'path mismatch' else 'process' end"))


def series_export(series: DataFrame) -> DataFrame:
    """Long chart points to one ordered list of {timestamp, value} per series (series are ring-bounded before)."""
    point = F.struct(F.col("t").alias("timestamp"), "value")
    return series.groupBy("client_id", "pid", "category", "name").agg(F.array_sort(F.collect_list(point)).alias("points"))
