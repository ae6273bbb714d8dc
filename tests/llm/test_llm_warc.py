"""Archives: round trip, revisits, rolling, equal bytes for equal rows, commits, damaged files."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from fleetscope.llm import warc
from fleetscope.llm.common import small_batches

SCHEMA = "page_id long, url string, html string, digest string, shard int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def files_of(path):
    return {p.name: p.read_bytes() for p in sorted(Path(path).glob("*.warc.gz"))}


def roles(df):
    return sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in df.collect()), key=str)


def test_round_trip(spark, sf, tmp_path):
    small_batches(spark)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    back = {r["page_id"]: r for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()}
    want = pages.collect()
    assert len(back) == len(want)
    for r in want:
        b = back[r["page_id"]]
        data = r["html"].encode()
        assert (bytes(b["payload"]), b["url"], b["payload_bytes"]) == (data, r["url"], len(data))
        assert b["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert not (tmp_path / "a" / "_temporary").exists()


def test_equal_rows_give_equal_files_in_order(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.repartition(5, "url").sortWithinPartitions("html")
    for name, df in (("a", pages), ("b", again)):
        warc.write_archive(df, str(tmp_path / name), shards=4, roll_bytes=20_000)
    a, b = files_of(tmp_path / "a"), files_of(tmp_path / "b")
    assert a == b and len({n[:11] for n in a}) == 4 and len(a) > 4
    texts = [gzip.decompress(a[n]) for n in sorted(a)]
    ids = [int(line.split(b":")[3]) for t in texts for line in t.split(b"\r\n") if line.startswith(b"WARC-Record-ID: <urn:page:")]
    assert ids == sorted(r["page_id"] for r in pages.collect())
    sizes = [len(x) for x in a.values()]
    assert max(sizes) < 20_000 + 20_000  # a file ends with the record that reaches the limit


def test_revisits(spark, tmp_path):
    rows = [(1, "u1", "<p>same"), (5, "u5", "<p>same"), (3, None, "<p>same"), (None, "n", "<p>same"), (2, "a", None), (4, "b", ""), (6, "c", "other"), (6, "d", "other"), (6, "d", "other"), (7, "é\r\nX: 1 ", "<p>é")]
    df = pages_of(spark, rows)
    out = warc.write_archive(df, str(tmp_path / "a"), shards=3)
    assert out.agg({"records": "sum"}).first()[0] == len(rows)
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [
        (1, "u1", "revisit", 5, 7, d("<p>same")), (5, "u5", "response", None, 7, d("<p>same")), (3, None, "revisit", 5, 7, d("<p>same")), (None, "n", "revisit", 5, 7, d("<p>same")),
        (2, "a", "revisit", 4, 0, d("")), (4, "b", "response", None, 0, d("")), (6, "c", "revisit", 6, 5, d("other")), (6, "d", "response", None, 5, d("other")),
        (6, "d", "revisit", 6, 5, d("other")), (7, "é%0D%0AX: 1%20", "response", None, 5, d("<p>é")),
    ]
    back = warc.read_archive(spark, str(tmp_path / "a"))
    assert roles(back) == sorted(want, key=str)
    full = sorted((r["page_id"] or 0, bytes(r["payload"])) for r in warc.restored(back).collect())
    assert full == sorted((i or 0, (t or "").encode()) for i, _, t in rows)
    warc.write_archive(df, str(tmp_path / "b"), least=6, shards=2)
    kinds = {(r["page_id"], r["url"]): r["record_type"] for r in warc.read_archive(spark, str(tmp_path / "b"), payloads=False).collect()}
    assert kinds[(2, "a")] == "response" and kinds[(6, "c")] == "response" and kinds[(1, "u1")] == "revisit"


def test_one_id_and_one_payload_for_most_rows(spark, tmp_path):
    df = pages_of(spark, [(9, f"u{i % 50}", "copy") for i in range(400)] + [(i, "v", f"page {i}") for i in range(200)])
    warc.write_archive(df, str(tmp_path / "a"), shards=8)
    back = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(back) == 600
    same = [r for r in back if r["payload_digest"] == warc.digest32(b"copy")]
    assert len(same) == 400 and sum(r["record_type"] == "response" for r in same) == 1 and {r["refers_to"] for r in same} == {None, 9}


def test_only_the_manifest_counts(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = tmp_path / "a"
    warc.write_archive(pages, str(path), shards=2)
    n = pages.count()
    (path / "shard-99999-00000.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.read_archive(spark, str(path)).count() == n
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, str(path))
    first = sorted(path.glob("*.warc.gz"))[0]
    data = first.read_bytes()
    first.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="ends inside|differs|broken"):
        warc.read_archive(spark, str(path)).collect()


def test_edges(spark, tmp_path):
    df = pages_of(spark, [(-(1 << 63), None, "x" * 3_000_000), (None, None, None), ((1 << 63) - 1, "", "ü")])
    warc.write_archive(df, str(tmp_path / "a"), shards=2)
    assert sorted(r["payload_bytes"] for r in warc.read_archive(spark, str(tmp_path / "a")).collect()) == [0, 2, 3_000_000]
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0
