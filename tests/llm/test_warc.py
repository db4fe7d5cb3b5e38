import gzip

import pytest

from tickloom.llm import warc
from tickloom.llm.common import stage_path

PAGES = "page_id long, url string, html string, block string, kind int"
ROWS = [(3, "http://a/x y", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, None), (5, "", ""), (None, "u\n", "<p>one</p>"),
        (7, "http://c", "é\r\n\r\nWARC/1.0\r\n\n1 0 x\n"), (7, "http://c", "é\r\n\r\nWARC/1.0\r\n\n1 0 x\n"), (8, "http://d", "x" * 300000), (9, "http://e", "lone")]


def frame(spark, rows=ROWS, parts=3):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], PAGES).repartition(parts)


def expected(rows, least):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = sorted((p for p, _, h in rows if (h or "") == (html or "")), key=lambda p: (p is None, p))
        again = len(data) >= least and len(same) > 1 and (page != same[0])
        out.append((page, len(data), warc.base32_sha1(data), "revisit" if again else "response", same[0] if again else None))
    if least <= len(ROWS[5][2].encode()):  # of two equal rows one revisits the other
        twice = next(i for i, r in enumerate(out) if r[0] == 7)
        out[twice] = (*out[twice][:3], "revisit", 7)
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 10**6])
def test_archives_read_back(spark, least):
    got = warc.archived(frame(spark), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == (expected(ROWS, least) if least < 10**6 else
                                                        sorted(((*r[:3], "response", None) for r in expected(ROWS, least)), key=str))


def test_both_versions_are_written_and_read(spark):
    path = stage_path(spark, "arc")
    warc.write_arc(frame(spark), path)
    rows = warc.read_arc(spark, path).collect()
    assert {r["version"] for r in rows} == {1, 2} and len(rows) == len(ROWS)
    assert {r["url"] for r in rows} >= {"http://a/x%20y", "-"}
    for r in rows:
        assert r["block"].startswith(r["head"]) and len(r["block"]) - len(r["head"]) == r["payload_bytes"]


def test_records_carry_what_the_format_asks_for(spark):
    arc, out = stage_path(spark, "arc"), stage_path(spark, "warc")
    warc.write_arc(frame(spark), arc)
    warc.convert(spark, arc, out)
    files = [gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(out).collect()]
    ids = set()
    for f in files:
        assert f.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") and f.endswith(b"\r\n\r\n")
        for r in warc.warc_records(f):
            ids.add(r["record_id"])
            assert r["date"] == "2024-01-01T00:00:00Z"
    rows = warc.read_warc(spark, out).collect()
    assert len(ids) == len(rows) == len(ROWS)
    assert all(r["refers_to_id"] in ids for r in rows if r["record_type"] == "revisit")


def test_an_arc_of_version_1_by_hand():
    body = b"1 0 Alexa\nURL IP-address Archive-date Content-type Archive-length\n"
    doc = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello\n\nworld"
    data = b"filedesc://a.arc 0.0.0.0 19960923142103 text/plain %d\n%s\n" % (len(body), body)
    data += b"http://h/ 1.2.3.4 19970101000000 text/html %d\n%s\n" % (len(doc), doc)
    data += b"dns:h 1.2.3.4 19970101000000 text/dns 3\nabc\n"
    one, two = warc.arc_records(data)
    assert (one["payload_bytes"], one["kind"], one["page_id"]) == (12, "response", None)
    assert (two["kind"], two["payload_bytes"], two["mime"]) == ("resource", 3, "text/dns")
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(data[:-4]))


def test_changed_payload_is_found(spark):
    arc, out = stage_path(spark, "arc"), stage_path(spark, "warc")
    warc.write_arc(frame(spark, ROWS[:1], 1), arc)
    warc.convert(spark, arc, out)
    data = gzip.decompress(spark.read.format("binaryFile").load(out).collect()[0]["content"])
    with pytest.raises(ValueError, match="digest"):
        list(warc.warc_records(data.replace(b"<p>one", b"<p>two")))


def test_no_pages(spark):
    assert warc.archived(frame(spark, [], 2)).collect() == []


def test_a_page_whose_url_looks_like_a_version_block(spark):
    rows = [(1, "filedesc://x", "<p>one</p>"), (2, "filedesc://part-0.arc", "2 0 x\n"), (3, "filedesc://x", "<p>one</p>"), (4, "http://a", None)]
    for parts in (1, 4):
        got = warc.archived(frame(spark, rows, parts)).select("page_id", "record_type", "refers_to").collect()
        assert sorted(tuple(r) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None)]
