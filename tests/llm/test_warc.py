import hashlib
import io

import pyarrow as pa
import pytest
import zstandard

from quarry.llm import warc

LONG = "é" * 60


def expected(rows):
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        group = [p for p, _, h in rows if (h or "") == (html or "")]
        least = min((p for p in group if p is not None), default=None)
        revisit = len(data) >= 100 and len(group) > 1 and least is not None and page != least
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame_bytes", [1, 700, 1 << 18])
def test_records_come_back_from_the_archives(spark, tmp_path, frame_bytes):
    rows = [(i, f"http://h/{i}\r\nX: y", LONG if i % 3 == 0 else f"<p>\r\n\r\nWARC/1.1 {i}" * (i % 40)) for i in range(120)]
    rows += [(500, None, None), (501, "u", ""), (3, "again", LONG), (0, "http://h/0\r\nX: y", LONG), (None, "n", LONG), (502, "big", "z" * 50_000), (503, "s", "x" * 99), (504, "s", "x" * 99)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_bundles(pages, f"file://{tmp_path}/w", frame_bytes=frame_bytes)
    assert index.count() == len(rows)
    got = warc.read_bundles(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    html = {r[0]: r[2] or "" for r in rows}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response")
    ids = spark.createDataFrame([(7,), (3,), (500,), (9999,), (7,)], "page_id long")
    assert sorted(r.page_id for r in warc.look_up(index, ids).collect()) == [3, 3, 7, 500]
    name = index.first().file.removeprefix("file://")
    with open(name, "rb") as f:  # any Zstandard tool reads it through
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")


def test_payload_of_a_third_is_spread_and_empty_tables_work(spark):
    pages = spark.range(300).selectExpr("id page_id", "'u' || id url", f"if(id % 3 = 0, '{LONG}', 'p' || id) html")
    roles = warc.with_roles(pages).collect()
    assert sorted(r.refers_to for r in roles if r.refers_to is not None) == [0] * 99
    index = warc.write_bundles(pages.limit(0))
    assert index.count() == 0 and warc.read_bundles(index).count() == 0


def test_damage_is_found():
    sink = io.BytesIO()
    sink.close, closed = lambda: None, sink
    writer = warc.BundleWriter(closed, 10)
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "d")
    writer.add(good)
    writer.add(good)
    writer.close()
    reader = warc.BundleReader(pa.BufferReader(sink.getvalue()))
    assert [reader.frame(k) for k in (1, 0)] == [good, good] and len(reader.starts) == 2
    with pytest.raises(ValueError):
        list(warc.parse(good.replace(b"abc", b"abd")))
    with pytest.raises(ValueError):
        warc.BundleReader(pa.BufferReader(sink.getvalue() + b"123456789"))


def test_hot_payloads_are_dealt_over_parts(spark):
    rows = [(i, "u", LONG if i % 2 else f"{i % 7}" * 200) for i in range(1, 400)]
    got = warc.with_roles(spark.createDataFrame(rows, "page_id long, url string, html string"), hot=10).collect()
    assert sorted((r.page_id, r.refers_to) for r in got) == sorted((p, r) for p, *_, r in expected(rows))
