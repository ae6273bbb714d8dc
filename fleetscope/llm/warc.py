"""WARC archives of pages: a deterministic sharded writer and its reader.

Records are ordered by page id and dealt into ranges. The bounds of the ranges are rows picked by a hash of the row, so
they follow from the rows and the number of ranges alone, not from Spark's sampling. A task writes the ranges it holds one after
the other: every record is a gzip member, its headers, lengths and SHA-1 digests made anew, and a file is closed when its
compressed size reaches the limit. Of records with equal payloads the one with the largest page id is a response, the
others are revisits of it.

Files are written below ``_temporary`` under a name of the attempt. Spark keeps the file list of the attempts that
succeeded; only those files are moved to their final names, and the manifest, written last, makes the archive valid.
The reader follows the manifest and checks sizes and digests. A lost executor costs the ranges of its tasks again; files
of lost attempts are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import stage

NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FILES = "name string, temporary string, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Candidates for each bound between two ranges.
OVERSAMPLE = 8


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for use inside tasks and on the driver alike."""
    return pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- records --------------------------------------------------------------------------------------------------------

def record_id(page_id: int | None, url: str | None, number: int) -> str:
    """Equal for equal input; ``number`` counts rows of one id and url with equal payloads."""
    mark = "null" if url is None else hashlib.sha1(url.encode()).hexdigest()[:16]
    return f"<urn:page:{'null' if page_id is None else page_id}:{mark}:{number}>"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return None if page == "null" else int(page)


def header_value(text: str) -> str:
    """Control characters, which would break a header, are percent-encoded, as are blanks at the ends."""
    inner = text.strip(" ")
    lead = len(text) - len(text.lstrip(" ")) if inner else 0
    return "%20" * lead + "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in inner) + "%20" * (len(text) - lead - len(inner))


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, number: int, payload: bytes, refers: tuple[str, str | None] | None, date: str = DATE) -> bytes:
    """A response, or, with the id and url of the record it refers to, a revisit, which keeps the HTTP header only."""
    fields = [("WARC-Record-ID", record_id(page_id, url, number)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0])]
    if refers[1] is not None:
        fields.append(("WARC-Refers-To-Target-URI", header_value(refers[1])))
    return record("revisit", fields, http)


def member(data: bytes, level: int) -> bytes:
    """One gzip member without time stamp or name, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    """A file under a temporary name; knows what the manifest says of it."""

    def __init__(self, folder: str, attempt: str, name: str, level: int) -> None:
        self.fs, base = open_fs(folder)
        self.name, self.temporary = name, f"_temporary/{attempt}/{name}"
        self.fs.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
        self.out = self.fs.open_output_stream(f"{base}/{self.temporary}", compression=None)
        self.records = self.bytes = 0
        self.hash, self.level = hashlib.sha1(), level
        info = b"software: fleetscope\r\nformat: WARC File Format 1.1\r\n"
        self._put(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))

    def _put(self, data: bytes) -> None:
        packed = member(data, self.level)
        self.out.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> tuple[str, str, int, int, str]:
        self.out.close()
        return self.name, self.temporary, self.records, self.bytes, self.hash.hexdigest()


# ---- writer ---------------------------------------------------------------------------------------------------------

def range_bounds(keys: DataFrame, shards: int) -> list[tuple[int, str]]:
    """Keys that divide the rows into about equal ranges; at most about ``2 * OVERSAMPLE`` keys a range reach the driver."""
    n = keys.count()
    every = max(1, n // (shards * OVERSAMPLE))
    picked = keys.where(F.pmod(F.xxhash64("k", "digest", F.lit(41)), F.lit(every)) == 0).select("k", "digest").distinct()
    found = sorted((r["k"], r["digest"]) for r in picked.limit(2 * OVERSAMPLE * shards + 1000).collect()) if shards > 1 else []
    return [found[i * len(found) // shards] for i in range(1, shards)] if len(found) >= shards else found


def slots(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark's hash deals to it, so that every range gets a task of its own."""
    dealt = spark.range(50 * n).selectExpr("cast(id as int) as v").selectExpr("v", f"pmod(hash(v), {n}) as p").groupBy("p").agg(F.min("v").alias("v"))
    found = {r["p"]: r["v"] for r in dealt.collect()}
    return [found.get(i, i) for i in range(n)]


def shard_column(bounds: list[tuple[int, str]], k: str, digest: str) -> Column:
    """Number of bounds not above (k, digest); only these two columns go through Python."""
    ids = np.array([b[0] for b in bounds], np.int64)
    digests = [b[1] for b in bounds]

    def shard(key: pd.Series, text: pd.Series) -> pd.Series:
        key = key.to_numpy(np.int64)
        low, high = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
        for i in np.flatnonzero(low < high):
            low[i] = bisect_right(digests, text.iloc[i], low[i], high[i])
        return pd.Series(low.astype(np.int32))

    return F.pandas_udf(shard, "int")(k, digest)


def marked(pages: DataFrame, least: int, salts: int = 16) -> DataFrame:
    """page_id, url, payload, digest and k (the id, null as the smallest number) of every row, with the id and url (w_id, w_url) of the row that a
    row with an equal payload of ``least`` bytes or more refers to, and ``twin``: whether there is one."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "k": F.coalesce("page_id", F.lit(NO_ID))})
    groups = own.select("digest", "page_id", "url", F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    last = groups.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    last = stage(last.selectExpr("digest", "w.page_id as w_id", "w.url as w_url", f"explode(sequence(0, {salts - 1})) as salt"), "warc-groups")
    return own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(
        last.withColumn("twin", F.lit(True)), ["digest", "salt"], "left"
    ).drop("salt")


def write_archive(
    pages: DataFrame, path: str, least: int = 0, shard_bytes: int = 16 << 20, roll_bytes: int = 64 << 20, shards: int | None = None, level: int = 6,
) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``path`` and return the manifest.

    A null html is an empty payload; a null url gives no target header; a null id counts as the smallest one. Rows that
    agree in id and payload are told apart by url, then by a running number; of rows with the largest id the largest url
    (null first) is the response. Texts are written whole. An empty table gives an empty manifest. Other columns are
    ignored. ``path`` must hold no archive. The files depend on the rows and the parameters; without ``shards`` there is a
    range for each ``shard_bytes`` of payload, 20,000 at most, and one for each shuffle partition at least. A range that is
    larger, as at the most it is, is several files of about ``roll_bytes``.
    """
    spark = pages.sparkSession
    files, base = open_fs(path)
    if files.get_file_info(f"{base}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    rows = marked(pages, least)
    keys = stage(rows.select("k", "digest", F.octet_length("payload").alias("size")), "warc-keys")
    if shards is None:
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = min(20_000, max(-(-total // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["shard", "k", "digest", "url"]
    place = F.element_at(F.lit(slots(spark, shards)), F.col("shard") + 1)
    ranged = rows.withColumn("shard", shard_column(range_bounds(keys, shards), "k", "digest")).withColumn("slot", place)
    dealt = ranged.repartition(shards, "slot").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, shard, last, number, seq, done = uuid.uuid4().hex, None, None, None, 0, 0, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "digest", "twin", "w_id", "w_url", "payload")), strict=True):
                at, page_id, url, digest, twin, w_id, w_url, payload = r
                if at != shard:
                    shard, seq = at, -1
                if out is not None and (seq < 0 or out.bytes >= roll_bytes):
                    done.append(out.close())
                    out = None
                if out is None:
                    seq += 1
                    out = _File(path, attempt, f"shard-{shard:05d}-{seq:05d}.warc.gz", level)
                number = number + 1 if (page_id, digest, url) == last else 0
                last = (page_id, digest, url)
                refers = (record_id(w_id, w_url, 0), w_url) if twin and (number or (page_id, url) != (w_id, w_url)) else None
                out.add(page_record(page_id, url, number, payload, refers))
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["name", "temporary", "records", "bytes", "sha1"])

    written = stage(dealt.select("shard", "page_id", "url", "digest", "twin", "w_id", "w_url", "payload").mapInArrow(write, FILES), "warc-files")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = open_fs(path)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                if own.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                    own.move(f"{root}/{temporary}", f"{root}/{name}")
                if own.get_file_info(f"{root}/{name}").size != size:  # moved by an earlier attempt of this task, or lost
                    raise OSError(f"{name} is not what was written")
            yield batch

    published = stage(written.repartition("name").mapInArrow(publish, FILES), "warc-published")
    published.select("name", "records", "bytes", "sha1").orderBy("name").coalesce(1).write.parquet(f"{path}/manifest")
    if files.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        files.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{path}/manifest")


# ---- reader ---------------------------------------------------------------------------------------------------------

def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(piece):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def parse(data: bytes) -> dict | None:
    """A row of a response or revisit, its digests checked; None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"broken payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record of the files in the manifest, read as streams; without ``payloads`` that column is null.

    A file that is missing, longer, shorter or other than the manifest says, or a record whose digests do not fit, raises. A
    revisit has the size and digest of the full payload, and a null payload (see ``restored``).
    """
    schema = spark.createDataFrame([], RECORDS).schema
    arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(path)
        for batch in batches:
            for name, records, size, sha1 in zip(*(batch.column(c).to_pylist() for c in ("name", "records", "bytes", "sha1")), strict=True):
                seen, length, whole, rows, held = 0, 0, hashlib.sha1(), [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as raw:

                    class Counted:
                        def read(self, n: int) -> bytes:
                            nonlocal length
                            data = raw.read(n)
                            whole.update(data)
                            length += len(data)
                            return data

                    for data in members(Counted()):
                        if (row := parse(data)) is None:
                            continue
                        seen += 1
                        held += len(data)
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                if (seen, length, whole.hexdigest()) != (records, size, sha1):
                    raise ValueError(f"{name} differs from the manifest")

    manifest = spark.read.parquet(f"{path}/manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "name").mapInArrow(read, schema)


def restored(records: DataFrame) -> DataFrame:
    """Records with the payload of each revisit taken from the response it refers to.

    The revisits, which carry no payload, wait for the responses; Spark splits a response that very many refer to as a skewed join.
    """
    whole, short = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    full = whole.selectExpr("page_id as of_page", "payload_digest as of_digest", "payload as of_payload")
    back = short.drop("payload").join(full, F.expr("refers_to <=> of_page and payload_digest = of_digest"), "left")
    return whole.unionByName(back.drop("of_page", "of_digest").withColumnRenamed("of_payload", "payload"))
