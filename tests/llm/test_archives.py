import hashlib
import io
import zipfile

import pytest

from colloquy.llm import archives


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files_and_ranges_are_right(zip64):
    out = io.BytesIO()
    z = archives.ZipWriter(out, zip64)
    members = {"archive/a.warc.gz": b"x" * 1000, "indexes/é.cdxj": b"{}\n", "empty": b""}
    for name, data in members.items():
        z.add(name, data)
    z.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as other:
        assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == members
    r = archives.ZipReader(lambda at, n: raw[at : at + n], len(raw))
    assert {n: r.read(m) for n, m in r.members.items()} == members
    assert r.read(r.members["archive/a.warc.gz"], 10, 5) == b"xxxxx"
    assert [m.name for m in r.stored("archive/")] == ["archive/a.warc.gz"]


def test_foreign_packages_and_broken_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc", b"abc")
        z.writestr(zipfile.ZipInfo("archive/deflated.warc"), b"z" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it"
    raw = out.getvalue()
    r = archives.ZipReader(lambda at, n: raw[at : at + n], len(raw))
    assert r.read(r.members["archive/data.warc"]) == b"abc"
    with pytest.raises(ValueError):
        r.stored("archive/")
    with pytest.raises(ValueError):
        archives.ZipReader(lambda at, n: b"no zip file here"[at : at + n], 16)


def test_records():
    digest = hashlib.sha1(b"<p>\r\n\r\nx").hexdigest()
    r = archives.parse_record(archives.write_record("7", "http://h/ä b", digest, b"<p>\r\n\r\nx", None))
    assert (r.kind, r.key, r.url, r.payload, r.payload_bytes, r.digest, r.refers_to) == ("response", "7", "http://h/ä%20b", b"<p>\r\n\r\nx", 8, digest, None)
    r = archives.parse_record(archives.write_record("7", None, digest, b"12345", "9"))
    assert (r.kind, r.payload, r.payload_bytes, r.refers_to) == ("revisit", None, 5, "9")
    with pytest.raises(ValueError):
        archives.parse_record(archives.write_record("7", "u", digest, b"other", None))


def test_round_trip(spark, sf_dir, tmp_path):
    extra = [(9001, "u v\n", "x" * 1500), (9002, "a", "x" * 1500), (9003, None, "x" * 999), (9004, "b", "x" * 999), (None, "c", "x" * 1500), (9005, "d", None), (9006, "é", "é" * 500), (9007, "f", "é" * 500), (9007, "f", "é" * 500)]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string"))
    rows = pages.collect()
    groups = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 1000 and r.page_id is not None:
            groups[b] = max(groups.get(b, r.page_id), r.page_id)
    want = []
    for r in rows:
        b = (r.html or "").encode()
        top = groups.get(b, r.page_id) if r.page_id is not None else None
        want.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if top == r.page_id else ("revisit", top))))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.round_trip(pages, str(tmp_path / "a")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert archives.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_packages_are_split_and_payloads_come_back(spark, tmp_path):
    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat('<p>', id, repeat(md5(cast(id AS string)), 40)) AS html").coalesce(1)
    packages = archives.write(archives.plan(pages), str(tmp_path / "p"), package_bytes=20_000, zip64=True).cache()
    assert packages.count() > 3 and packages.agg({"n_records": "sum"}).first()[0] == 200
    got = archives.read(archives.locate(packages), payloads=True)
    assert {(r.page_id, bytes(r.payload).decode()) for r in got.collect()} == {(r.page_id, r.html) for r in pages.collect()}
