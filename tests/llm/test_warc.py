"""Bundles of WARC records: layout, round trips, and what revisits what."""

from __future__ import annotations

import glob
import hashlib
import os

import pytest
import zstandard

from tessella.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows, least=100):
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= least and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


def test_query_equals_brute_force_and_leaves_no_files(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = warc.op11_warc_bundles(spark, sf_dir)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect())) == brute(rows)
    folder = warc.shared_folder(spark).removeprefix("file:")
    assert not glob.glob(f"{folder}/tessella/warc-*/*.zst")


def test_bundles_round_trip_and_frames_stand_alone(spark, tmp_path, monkeypatch):
    shared = "x" * 150
    rows = [(i, f"http://a/{i} ü\r\nEvil: 1", f"<p>{i}</p>\r\n\r\nWARC/1.1" + "y" * (i % 700)) for i in range(400)] + [(400 + i, None, shared) for i in range(60)] + [(900, "u", None), (901, "u", ""), (902, "u", "x" * 99), (903, "u", "x" * 99)]
    folder = f"file://{tmp_path}/bundles"
    index = warc.write_bundles(pages_of(spark, rows), folder)
    assert index.count() == len(rows)
    records = {r["record"]: r for r in warc.read_bundles(index, folder).collect()}
    assert len(records) == len(rows)
    for i, url, html in rows:
        r = records[f"urn:page:0:{i}"]
        assert r["url"] == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
        if r["kind"] == "response":
            assert bytes(r["payload"]) == (html or "").encode()
        else:
            assert r["payload"] is None and r["refers"] == "urn:page:0:400" and r["digest"] == hashlib.sha256(shared.encode()).hexdigest()
    assert [r["kind"] for k, r in records.items() if k in ("urn:page:0:902", "urn:page:0:903", "urn:page:0:900")] == ["response"] * 3
    # any reader of Zstandard sees the records one after another
    total = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read() for p in glob.glob(f"{tmp_path}/bundles/*.zst"))
    assert total.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and len(total) == sum(r["length"] for r in index.collect())
    wanted = index.where("record like '%7'")
    assert sorted((r["record"], r["kind"]) for r in warc.fetch(wanted, folder).collect()) == sorted((r["record"], r["kind"]) for r in wanted.collect())


def test_many_frames_and_bundles(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    bundle = warc._Bundle(f"file://{tmp_path}")
    places = [bundle.add(warc.record_bytes(f"urn:{i}", "response", None, warc.DATE, "0", None, b"z" * (i * 7 % 300))) for i in range(50)]
    bundle.close()
    store, root = warc._store(f"file://{tmp_path}")
    with store.open_input_file(f"{root}/{bundle.name}") as f:
        frames = warc.seek_table(f)
        assert len(frames) == places[-1][0] + 1 > 10
        for i in (49, 3, 20):
            headers, payload, _ = warc.parsed(warc.unpacked(f, *frames[places[i][0]]), places[i][1])
            assert headers["WARC-Record-ID"] == f"<urn:{i}>" and payload == b"z" * (i * 7 % 300)
    assert os.listdir(tmp_path) == [bundle.name]


def test_damage_is_seen(tmp_path):
    bundle = warc._Bundle(f"file://{tmp_path}")
    bundle.add(warc.record_bytes("urn:1", "response", "u", warc.DATE, "0", None, b"text" * 100))
    bundle.close()
    path = f"{tmp_path}/{bundle.name}"
    data = bytearray(open(path, "rb").read())
    data[-10] ^= 1  # the checksum
    open(path, "wb").write(bytes(data))
    store, _ = warc._store(f"file://{tmp_path}")
    with store.open_input_file(path) as f, pytest.raises(ValueError, match="damaged"):
        warc.unpacked(f, *warc.seek_table(f)[0])


def test_repeated_and_null_ids(spark, tmp_path):
    html = "w" * 200
    rows = [(5, "u", html), (5, "u", html), (None, "v", html), (None, None, None), (7, "u", html), (7, "u", "short"), (7, "u", "short")]
    folder = f"file://{tmp_path}/b"
    pages = pages_of(spark, rows).selectExpr("*", "1 AS record", "2 AS digest", "3 AS payload")
    found = warc.described(warc.read_bundles(warc.write_bundles(pages, folder), folder))
    out = found.select(warc.record_id(found["record"]).alias("id"), "payload_bytes", "kind", warc.record_id(found["refers"]).alias("refers")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [("5", 200, "response", None), ("5", 200, "revisit", "5"), (None, 200, "revisit", "5"), (None, 0, "response", None), ("7", 200, "revisit", "5"), ("7", 5, "response", None), ("7", 5, "response", None)]))


def test_empty_table_and_large_payload(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    index = warc.write_bundles(pages_of(spark, []), folder)
    assert index.count() == 0 and warc.read_bundles(index, folder).count() == 0 and warc.fetch(index, folder).count() == 0
    text = "ä" * 3_000_000
    index = warc.write_bundles(pages_of(spark, [(1, "u", text), (2, "u", text)]), folder)
    assert {(r["kind"], r["payload_bytes"]) for r in warc.described(warc.read_bundles(index, folder)).collect()} == {("response", 6_000_000), ("revisit", 6_000_000)}


def test_a_task_that_fails_leaves_no_bundle(spark, tmp_path, monkeypatch):
    bundle = warc._Bundle(f"file://{tmp_path}")
    bundle.add(b"part")
    bundle.abort()
    assert os.listdir(tmp_path) == []
