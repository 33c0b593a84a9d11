import base64
import gzip
import hashlib

import pyarrow.fs
import pytest
from docassay.llm import queries, warc
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_against_plain_grouping(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = {(i, len(p), digest(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages.items()}
    got = queries.op8_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(pages)


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_warc"])
    got = queries.op8_warc(spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def pages(spark):
    schema = "page_id long, url string, html string, payload string, digest_ int"
    rows = [(3, "http://a/é x", "one\r\n\r\nWARC/1.1\r\n", "p", 1), (1, None, "two", "p", 1), (2, "http://b/", "two", "p", 1), (4, "u", None, "p", 1), (5, "u", "", "p", 1), (6, "u", "big " * 200000, "p", 1), (None, "u", "two", "p", 1), (1, None, "two", "p", 1), (None, "n", "nil", "p", 1)]
    return spark.createDataFrame(rows, schema)


def test_odd_rows(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
    want = [(3, 17, "response", None), (1, 3, "response", None), (1, 3, "response", None), (2, 3, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (6, 800000, "response", None), (None, 3, "revisit", 1), (None, 3, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_ids_and_urls_of_any_form(spark, monkeypatch):
    rows = [("a  b", "http://x/a  b", "one"), ("a b", "http://x/a b", "two"), ("", "u", "three"), ("é/?%20<>", "http://x/%20é", "one"), ("z\n", "u", "one"), (None, "u", "two")]
    d = spark.createDataFrame(rows, "page_id string, url string, html string")
    for most in (warc.MOST_BROADCAST, 0):
        monkeypatch.setattr(warc, "MOST_BROADCAST", most)
        got = {(r.page_id, r.record_type, r.refers_to, r.target_uri) for r in warc.round_trip(d).collect()}
        assert got == {
            ("a  b", "response", None, "http://x/a%20%20b"), ("a b", "response", None, "http://x/a%20b"), ("", "response", None, "u"),
            ("é/?%20<>", "revisit", "a  b", "http://x/%20é"), ("z\n", "revisit", "a  b", "u"), (None, "revisit", "a b", "u"),
        }


def archive(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write(warc.to_records(pages(spark)).coalesce(1), path)
    return path


def test_headers_are_read_first_and_payloads_passed_over(spark, tmp_path):
    path = archive(spark, tmp_path)
    reader = warc.Reader({"path": path})
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 1), In(("target_uri",), ("http://b/", "u"))]))
    assert left == [GreaterThan(("payload_length",), 1)]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 1 and {r["record_type"] for r in rows} == {"revisit"} and reader.passed_over == 9 - len(rows) == 6
    # Little more than headers of the unwanted records is inflated.
    inflated = 0
    fs, _ = warc.file_system(path)

    class Counting(warc.Member):
        def read(self, most):
            nonlocal inflated
            out = super().read(most)
            inflated += len(out)
            return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc, "Member", Counting)
        with fs.open_input_file(parts[0].path) as file:
            assert sum(1 for _ in warc.records(file, parts[0].size, lambda h: False, True)) == 9
    assert inflated <= 9 * 1024
    plan = warc.read(spark, path).where("record_type = 'revisit' and target_uri like 'http%'")
    assert plan.count() == 1 and warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    lengths = lambda payload: sorted((r.record_id, r.record_type, r.payload_length) for r in warc.read(spark, path, payload).collect())
    assert lengths(False) == lengths(True)


def test_other_writers_archives(spark, tmp_path):
    plain = warc.record({"record_type": "response", "record_id": "<urn:x-page:1>", "payload": b"a\r\n\r\nb", "payload_length": 6})
    folded = plain.replace(b"WARC-Type: response", b"warc-type:\r\n response")
    (tmp_path / "a.warc").write_bytes(plain + folded)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(folded))
    (tmp_path / "_skipped").write_bytes(b"x")
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload), r.payload_length) for r in rows] == [("response", b"a\r\n\r\nb", 6)] * 4
    (tmp_path / "c.warc").write_bytes(plain[:-20])
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, str(tmp_path)).collect()


def test_a_failed_or_repeated_task_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = warc.Writer({"path": str(tmp_path / "w")}, False)
    batch = pa.RecordBatch.from_pylist([{"record_type": "response", "record_id": "<r>", "payload": b"x", "payload_length": 1}])
    kept, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept])
    names = [f.base_name for f in pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(str(tmp_path / "w"), recursive=True))]
    assert names == kept.files and lost.files != kept.files
    other = warc.Writer({"path": str(tmp_path / "w")}, False)
    other.write(iter([batch]))
    other.abort([])
    assert len(list((tmp_path / "w").iterdir())) == 1


def test_base32(spark):
    for text in ("", "a", "payload"):
        got = spark.range(1).select(warc.base32(F.sha1(F.lit(text)))).first()[0]
        assert got == digest(text.encode())
