"""Archives: exact round trips, revisits, and ZIP64 directories."""

import base64
import hashlib
import zipfile

import pytest
from pyarrow import fs

from souklens.llm import warc

ROWS = [(1, "http://a/é x", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "http://e", "x\r\n\r\n" * 50_000), (6, "u", "\x00\r\n"),
        (6, "u", "\x00\r\n"), (None, "v", "<p>é</p>"), (None, "w", "alone"), (9, "z", "last")]


def plain(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        target = max(ids, default=None) if len(payload) >= least and sum((h or "").encode() == payload for *_, h in rows) > 1 else None
        revisit = target is not None and page != target
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", target if revisit else None,
                    None if revisit else payload))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, least=least, most_bytes=1000)
    assert archives.agg({"records": "sum"}).first()[0] == len(ROWS) and archives.count() > 1
    assert result(warc.read_archives(archives)) == plain(ROWS, least)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).collect() == []


def test_urls_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://d/ä\r\nX: y", "p", "d")], "page_id long, url string, html string, digest string")
    row = warc.read_archives(warc.write_archives(pages)).first()
    assert row["url"] == "http://d/%C3%A4%0D%0AX: y"


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # every size and offset goes to the wide fields
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
        archive.comment = b"a comment behind the directory"
        for name, data in (("one", b"1" * 100), ("two", b"2" * 50)):
            archive.writestr(name, data)
        archive.writestr("packed", b"3" * 500, zipfile.ZIP_DEFLATED)
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        members = warc.directory(file)
        assert set(members) == {"one", "two"}  # only stored members can be read by ranges
        assert warc.read_range(file, members["two"].begin, members["two"].size) == b"2" * 50


def test_archives_are_zip_files(spark):
    archives = warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1))
    path = archives.first()["path"].removeprefix("file://").removeprefix("file:")
    with zipfile.ZipFile(path) as archive:
        assert archive.testzip() is None and set(archive.namelist()) == {warc.RECORDS, warc.INDEX}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in archive.infolist())


def test_a_changed_payload_is_noticed():
    data = warc.record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="differs"):
        warc.parse(data.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
    with pytest.raises(ValueError, match="complete"):
        warc.parse(data[:-1])
