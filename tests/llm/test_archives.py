"""ARC to WARC against plain Python over the same pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pyarrow as pa

from faultlens.llm import archives as A
from faultlens.plans.materialize import scratch_path

PAGES = "page_id long, url string, html string, path string, first string, offset string, head string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", "f", "o", "h") for i, u, h in rows], PAGES).repartition(3)


def hard_pages():
    same = "<p>same</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    return [
        (9, "http://a.example/x y", same),
        (4, "https://b.example/", same),
        (5, None, None),
        (6, "", ""),
        (7, "no-scheme", "line\nfiledesc://x 0.0.0.0 20240101000000 text/plain 5\nhttp://c.example/ 1.2.3.4 2024 text/html 4\n"),
        (8, "http://c.example/\n", "x" * 300_000 + "\n" * 50),
        (10, "http://d.example/", "ünï \U0001f600 \x00 end\r\n\r\n"),
        (4, "https://b.example/", same),
        (None, "http://e.example/", same),
        (None, "http://f.example/", "only here, without an id"),
        (11, "http://g.example/", "\r\n\r\n"),
        (12, "http://h.example/", "\n"),
    ]


def expected(rows, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to), of repeated rows one response."""
    taken, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = len(data) >= min_bytes and digest in taken
        out.append((page_id, len(data), digest, "revisit" if again else "response", taken[digest] if again else None))
        taken.setdefault(digest, page_id)
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    assert all(r["intact"] for r in rows)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_pages_come_back(spark):
    table = pages(spark, hard_pages())
    assert found(A.archive(table, scratch_path(spark, "archives"))) == expected(hard_pages())
    assert found(A.archive(table, scratch_path(spark, "archives"), min_bytes=50)) == expected(hard_pages(), 50)


def test_no_pages(spark):
    assert found(A.archive(pages(spark, hard_pages()).filter("false"), scratch_path(spark, "archives"))) == []


def test_large_first_side(spark, monkeypatch):
    """The shuffled join gives the same records as the broadcast one."""
    from faultlens.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert found(A.archive(pages(spark, hard_pages()), scratch_path(spark, "archives"))) == expected(hard_pages())


def test_both_versions_are_written_and_read(spark):
    path = scratch_path(spark, "arc")
    A.write_arc(pages(spark, hard_pages()), path)
    rows = A.read_arc(spark, path, blocks=True).collect()
    infos = [r for r in rows if r["warc_type"] == "warcinfo"]
    assert {r["version"] for r in infos} == {1, 2} and {r["version"] for r in rows} == {1, 2}
    assert len({r["record_id"] for r in rows}) == len(rows)
    named = {r["record_id"]: r["path"] for r in infos}
    assert all(named[r["info_id"]] == r["path"] for r in rows if r["warc_type"] == "response")
    assert sorted(r["payload"].decode() for r in rows if r["warc_type"] == "response") == sorted(h or "" for _, _, h in hard_pages())
    assert {r["date"] for r in rows} == {"2024-01-01T00:00:00Z"}


def test_revisits_hold_no_payload_and_name_their_response(spark):
    path = scratch_path(spark, "archives")
    A.archive(pages(spark, hard_pages()), path).count()
    text = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/warc/*.gz").collect())
    records = list(A.Framing(A.WARC_END, A._warc_length).feed(text))
    kinds = {}
    for _, head, block, whole in records:
        kinds.setdefault(A._head_value(head, b"WARC-Type"), []).append((head, block))
        assert whole
    ids = {A._head_value(h, b"WARC-Record-ID"): h for h, _ in kinds["response"]}
    for head, block in kinds["revisit"]:
        first = ids[A._head_value(head, b"WARC-Refers-To")]
        assert A._head_value(first, b"WARC-Payload-Digest") == A._head_value(head, b"WARC-Payload-Digest")
        assert A._head_value(first, b"WARC-Target-URI") == A._head_value(head, b"WARC-Refers-To-Target-URI")
        assert block.endswith(b"\r\n\r\n") and b"WARC-Profile: " + A.REVISIT_PROFILE.encode() in head
    assert len(kinds["warcinfo"]) == 3


def legacy(version, records, cut=None):
    block = f"{version} 0 somebody\n{A.ARC_FIELDS[version]}\n".encode()
    whole = A.arc_header(version, "filedesc://old.arc", "19970301", "text/plain", len(block)).encode() + b"\n" + block + b"\n"
    for head, body in records:
        whole += head + b"\n" + body + b"\n"
    return whole[:cut]


def test_legacy_files(spark, tmp_path):
    """Unescaped addresses, missing fields, short dates, other content, damage and a cut end."""
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>one\ntwo</html>"
    one = [
        (b"http://x.example/a b c 10.0.0.1 199703011530 text/html %d" % len(http), http),
        (b"this is no header", b"lost\nlines"),
        (b"dns:x.example 10.0.0.2 19970301153000 text/dns 9", b"a\nb\nc\nd e"),
        (b"http://y.example/ 10.0.0.3 nonsense text/html 5", b"12345"),
    ]
    two = [(b"http://z.example/ 10.0.0.4 19990101000000 text/html 200 - - 0 f.arc %d" % len(http), http), (b"http://short.example/ 5", b"abcde")]
    for name, data in (("a", legacy(1, one)), ("b", legacy(2, two)), ("c", legacy(2, two, -4))):
        (tmp_path / f"{name}.arc.gz").write_bytes(gzip.compress(data))
    rows = A.read_arc(spark, str(tmp_path), blocks=True).collect()
    by = {(r["path"].rsplit("/", 1)[-1][0], r["url"]): r for r in rows}
    a = by["a", "http://x.example/a b c"]
    assert (a["ip"], a["date"], a["warc_type"], a["payload"]) == ("10.0.0.1", "1997-03-01T15:30:00Z", "response", b"<html>one\ntwo</html>")
    assert (by["a", "dns:x.example"]["warc_type"], by["a", "dns:x.example"]["payload"]) == ("resource", b"a\nb\nc\nd e")
    assert by["a", "http://y.example/"]["date"] == "1970-01-01T00:00:00Z"
    assert by["a", "filedesc://old.arc"]["date"] == "1997-03-01T00:00:00Z"
    assert by["b", "http://z.example/"]["mime"] == "text/html" and by["b", "http://short.example/"]["payload"] == b"abcde"
    assert [by[f, "http://short.example/"]["truncated"] for f in "bc"] == [False, True]
    assert by["c", "http://short.example/"]["payload"] == b"ab" and len(rows) == 10
    A.convert(spark, str(tmp_path), scratch_path(spark, "warc") + "/w")


def test_framing_does_not_depend_on_chunks():
    rng = random.Random(5)
    blocks = [bytes(rng.choice(b"a\r\n :1") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    text = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + A.WARC_END for b in blocks)
    rows = text.split(A.WARC_END)[:-1]
    for size in (1, 2, 7, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"path": ["f"] * len(p), "value": p}) for p in parts]
        got = list(A.framed(iter(batches), A.WARC_END, A._warc_length))
        assert [g[3] for g in got] == blocks and all(g[4] for g in got)
        assert [text[g[1] : g[1] + 8] for g in got] == [b"WARC/1.1"] * len(blocks)
