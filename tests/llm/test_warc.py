import hashlib
import io
import zlib

import pytest

from lodestone.llm import warc


def test_reader():
    pages = [("1", "http://a/b c\r\nX: y", "é\r\n\r\n".encode() * 9, None), ("2", None, b"", None), ("3", "u", b"x" * 5_000_000, "1")]
    data = b"".join(warc.page_record(*p) for p in pages) + warc.record([("WARC-Type", "metadata")], b"m")
    got = list(warc.records(io.BytesIO(data)))
    assert [h["warc-type"] for h, _, _ in got] == ["response", "response", "revisit", "metadata"] and all(ok for *_, ok in got)
    read = [warc.page(*g) for g in got[:3]]
    assert [r[:2] for r in read] == [("1", 54), ("2", 0), ("3", 5_000_000)]
    assert [r[2] for r in read] == [hashlib.sha1(p[2]).hexdigest() for p in pages]
    assert [r[4:] for r in read] == [(None, pages[0][2], True), (None, b"", True), ("1", None, True)]
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n", wbits=31))))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(b"plain")))
    bad = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", warc.digest(b"other"))], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")
    headers, block, ok = next(warc.records(io.BytesIO(bad)))
    assert not warc.page({**headers, "warc-record-id": "<urn:record:1>"}, block, ok)[-1]


def test_round_trip(spark):
    big = "long é " * 400
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"page {i} " * (i % 300), "clash") for i in range(600)]
    rows += [(601, None, None, None), (602, "u", "", None), (None, "u", big, None), (597, "u", big, None), (603, "u", "z" * 3_000_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(3)
    got = warc.through_archives(df).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    last = max(i for i, _, h, _ in rows if h == big and i is not None)
    for r in got:
        html = next(h or "" for i, _, h, _ in rows if i == r.page_id)
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = html == big and r.page_id is not None and r.page_id < last
        assert (r.record_type, r.refers_to) == (("revisit", last) if again else ("response", None))
    files = warc.write(warc.plan(df), most=20_000)
    assert files.count() > 6 and files.agg({"records": "sum"}).first()[0] == len(rows)
    back = {(r.id, r.record_type): r.payload for r in warc.read(files).collect()}
    assert back["603", "response"] == b"z" * 3_000_000


def test_empty(spark):
    assert warc.through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lawful_foreign_archives():
    """Records that other writers make: chunks, digests in hex, none at all, no lengths, odd lines, other schemes."""
    body = b"<p>one</p>" * 9
    sha = hashlib.sha1(body).hexdigest()
    chunks = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x};x=y\r\n".encode() + body[5:] + b"\r\n0\r\n\r\n"
    make = lambda extra, block, kind="response": warc.record([("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), *extra], block)
    http = ("Content-Type", "application/http; msgtype=response")
    some = [
        (make([http], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks), body, True),
        (make([http, ("WARC-Payload-Digest", f"sha1:{sha}")], b"HTTP/1.1 200 OK\r\nno colon\r\nServer:x\r\n folded\r\n\r\n" + body), body, True),
        (make([http, ("WARC-Payload-Digest", f"SHA-256:{hashlib.sha256(body).hexdigest()}")], b"HTTP/1.0 200\r\n\r\n" + body), body, True),
        (make([http, ("WARC-Payload-Digest", f"sha1:{'0' * 40}")], b"HTTP/1.0 200\r\n\r\n" + body), body, False),
        (make([http, ("WARC-Payload-Digest", "crc99:abc")], b"HTTP/1.0 200\r\n\r\n" + body), body, True),
        (make([("Content-Type", "text/dns")], b"20200101\r\nx. 1 IN A 1.2.3.4\r\n"), b"20200101\r\nx. 1 IN A 1.2.3.4\r\n", True),
        (make([http], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz not chunks"), b"zz not chunks", True),
    ]
    got = [warc.page(*r) for r in warc.records(io.BytesIO(b"".join(s[0] for s in some)))]
    assert [(g[5], g[6]) for g in got] == [s[1:] for s in some]
    assert all(g[1] == len(g[5]) and g[2] == hashlib.sha1(g[5]).hexdigest() for g in got)
    bare = next(warc.records(io.BytesIO(make([("WARC-Profile", warc.PROFILE)], b"", "revisit"))))
    assert warc.page(*bare)[1:6] == (None, None, "revisit", None, None)


def test_members_are_inflated_piece_by_piece():
    """A member that inflates to far more than its length tells is never held whole."""
    import tracemalloc

    bomb = zlib.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + b"\0" * 200_000_000, wbits=31)
    tracemalloc.start()
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(bomb)))
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
