import base64
import gzip
import hashlib

import pytest

from quire.llm import warc

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rows = [(7, "http://a b/", b"x\r\n\r\ny"), (None, None, b""), (-3, "http://c/", "é\n\nfiledesc://".encode())]
    about, *records = warc.parse_arc(warc.write_arc(rows, version))
    assert about.url == "filedesc://pages.arc" and about.body.startswith(b"%d 0 " % version)
    assert [r.http[1] for r in records] == [p for *_, p in rows]
    assert [r.http[0]["x-source-key"] for r in records] == ["7", "", "-3"]
    assert records[0].url == "http://a%20b/" and records[1].url == "-" and {r.version for r in records} == {version}
    assert records[0].code == ("200" if version == 2 else "-")


def test_truncated_arc_is_refused():
    data = warc.write_arc([(1, "u", b"payload")], 1)
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(data[:-4]))


def test_conversion_fields():
    _, record = warc.parse_arc(warc.write_arc([(1, "http://a/", b"body")], 2))
    made = warc.convert(record)
    ((headers, block),) = warc.parse_warc(made + warc.RECORD_END)
    assert headers["warc-type"] == "response" and headers["warc-date"] == "1970-01-01T00:00:00Z"
    assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    assert block.endswith(b"\r\n\r\nbody") and headers["warc-record-id"].startswith("<urn:uuid:")
    assert warc.convert(record) == made


def test_wrong_length_is_refused():
    _, record = warc.parse_arc(warc.write_arc([(1, "u", b"abc")], 1))
    data = warc.convert(record).replace(b"abc", b"abcd") + warc.RECORD_END
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_warc(data))


ROWS = [(5, None, None), (7, "u r", "a\r\n\r\nWARC/1.1"), (9, "u", "a\r\n\r\nWARC/1.1"), (None, "u", ""), (3, "x", "é"), (3, "x", "é"), (11, "l", "y" * 400_000), (12, "m", "z\n" * 9)]


def test_archive_pages(spark, clashing):
    got = warc.archive_pages(clashing(spark.createDataFrame(ROWS, SCHEMA))).collect()
    want = []
    for page, _, html in ROWS:
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        last = max(same)
        data = (html or "").encode()
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == last else "revisit", None if page == last else last))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)


def test_small_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 2 * warc.SMALL_PAGE)
    monkeypatch.setattr(warc, "PIECE", 64)
    got = warc.archive_pages(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/w")
    assert got.count() == len(ROWS) and len(list((tmp_path / "w").glob("size=*/part-*"))) >= 4


def test_large_pages_have_files_of_their_own(spark, monkeypatch, tmp_path):
    """No file holds more than the bound or one record."""
    monkeypatch.setattr(warc, "SMALL_PAGE", 100)
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (10 * 3 ** (i % 6) + i)) for i in range(60)]
    got = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(t)) for i, _, t in rows]
    for file in (tmp_path / "w").glob("size=*/part-*"):
        blocks = [len(block) for headers, block in warc.parse_warc(warc.pieces(file.read_bytes())) if headers["warc-type"] != "warcinfo"]
        assert len(blocks) == 1 or sum(blocks) <= 1000 + 200 * len(blocks)


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "other")]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    found = [h for f in (tmp_path / "w").glob("size=*/part-*") for h, _ in warc.parse_warc(warc.pieces(f.read_bytes()))]
    by_url = {h.get("warc-target-uri"): h for h in found if h["warc-type"] != "warcinfo"}
    assert by_url["http://a/"]["warc-type"] == "revisit" and by_url["http://b/"]["warc-type"] == "response"
    assert by_url["http://a/"]["warc-refers-to"] == by_url["http://b/"]["warc-record-id"] and by_url["http://a/"]["warc-refers-to-target-uri"] == "http://b/"
    assert {h["warc-type"] for h in found} == {"warcinfo", "response", "revisit"} and all("warc-filename" in h for h in found if h["warc-type"] == "warcinfo")


def test_legacy_files_from_storage(spark, tmp_path):
    """Records of several protocols, plain and gzip (a member for each record), with WARC records of the right types."""
    http = b"HTTP/1.0 404 Not Found\r\nContent-Type: text/plain\r\n\r\nnone"
    about = b"1 0 older\nURL IP-address Archive-date Content-type Archive-length\n"
    records = [
        b"filedesc://x.arc 0.0.0.0 19961114 text/plain %d\n%s\n" % (len(about), about),
        b"http://h/ 1.2.3.4 19970102030405 text/plain %d\n%s\n" % (len(http), http),
        b"dns:h.org 1.2.3.4 19970102 text/dns 9\nh A 1.2.3\n",
    ]
    (tmp_path / "a.arc").write_bytes(b"".join(records))
    (tmp_path / "b.arc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read_arc(spark, f"file://{tmp_path}").collect()
    assert len(got) == 6
    for name in ("a.arc", "b.arc.gz"):
        own = [r for r in got if r.file.endswith(name)]
        heads = [next(warc.parse_warc(bytes(r.warc) + warc.RECORD_END)) for r in own]
        assert [h["warc-type"] for h, _ in heads] == ["warcinfo", "response", "resource"]
        assert [h["warc-date"] for h, _ in heads] == ["1996-11-14T00:00:00Z", "1997-01-02T03:04:05Z", "1997-01-02T00:00:00Z"]
        assert heads[1][1] == http and heads[2][1] == b"h A 1.2.3" and heads[2][0]["content-type"] == "text/dns"
        assert heads[1][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"none").digest()).decode()


@pytest.mark.parametrize("cut", [1, 9])
def test_truncated_gzip_is_refused(cut):
    with pytest.raises(ValueError, match="too soon"):
        list(warc.pieces(gzip.compress(b"text " * 100)[:-cut]))


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []
