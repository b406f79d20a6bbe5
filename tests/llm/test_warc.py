import hashlib

import pytest
from marlpath.llm import warc
from marlpath.llm.frames import new_path


def archive(spark, df, **options):
    path = new_path(spark, "warc")
    warc.write_archive(df, path, **options)
    return path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, head string, payload string")


def test_records_are_rebuilt_exactly(spark):
    big, small = "<p>" + "á\r\n\r\nx" * 40, "<p>tiny"
    df = pages(spark, [(5, "http://a/5", big, "h", "p"), (2, "http://a/2", big, "h", "p"), (9, None, big, "h", "p"), (3, "http://a/3\r\nX: y", small, "h", "p"), (1, "http://a/1", small, "h", "p"), (4, "u", None, "h", "p"), (6, "u", "", "h", "p")])
    path = archive(spark, df)
    rows = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {
        2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None)
    }
    for k, r in rows.items():
        html = {5: big, 2: big, 9: big, 3: small, 1: small}.get(k, "").encode()
        assert bytes(r["payload"]) == html and r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and len(lines) == (10 if r["record_type"] == "revisit" else 8)
        size = int(next(x for x in lines if x.startswith("Content-Length:")).split(":")[1])
        assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith(html if r["record_type"] == "response" else b"\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3  # each different payload once


def test_files_round_trip(spark, tmp_path):
    df = pages(spark, [(i, f"http://a/{i}", ("x\r\n\r\ny" * 30) if i % 3 else f"only {i}", "h", "p") for i in range(40)])
    records = warc.read_archive(spark, archive(spark, df))
    warc.export_files(records, str(tmp_path / "out"), records_a_file=7)
    got = sorted((r["head"].encode() + bytes(r["block"]) + b"\r\n\r\n") for r in warc.import_files(spark, str(tmp_path / "out")).collect())
    assert got == sorted(bytes(r["record"]) for r in records.collect())


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "z" * 200
    df = pages(spark, [(1, "u", text, "h", "p"), (1, "u", text, "h", "p"), (None, "u", text, "h", "p"), (None, "u", "n" * 150, "h", "p")])
    rows = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, archive(spark, df)).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None)]))
    assert warc.read_archive(spark, archive(spark, pages(spark, []))).count() == 0


def test_a_damaged_payload_raises(spark):
    path = archive(spark, pages(spark, [(1, "u", "q" * 120, "h", "p")]))
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("payload_digest", "cast('other' as binary) as payload")
    worse = new_path(spark, "warc")
    bad.write.parquet(f"{worse}/payloads")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{worse}/heads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, worse).collect()
