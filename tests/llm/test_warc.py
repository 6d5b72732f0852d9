from __future__ import annotations

import base64
import hashlib
import random

from gaugelab.llm import warc
from gaugelab.storage import run_folder


def archive(payloads, packed=True) -> tuple[bytes, list[tuple[int, int]]]:
    data, places = b"", []
    for i, p in enumerate(payloads):
        r = warc.record_bytes(f"urn:page:{i}:x", f"http://a/{i}", p, warc.base32_sha1(hashlib.sha1(p).digest()), None)
        r = warc.gzip_member(r) if packed else r
        places.append((len(data), len(data) + len(r)))
        data += r + (warc.EMPTY_MEMBER if packed else b"")
    return data, places


def test_undamaged():
    payloads = [b"", b"<html>", bytes(range(256)) * 400, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", warc.gzip_member(b"inner")]
    for packed in (True, False):
        data, places = archive(payloads, packed)
        found = list(warc.salvage(data))
        assert [f.payload for f in found] == payloads
        assert [(f.begin, f.end) for f in found] == places
    both = archive(payloads[:2])[0] + archive(payloads[2:3], False)[0] + warc.gzip_member(archive(payloads[:2], False)[0])
    assert [f.payload for f in warc.salvage(both)] == [*payloads[:3], *payloads[:2]]


def test_damage_costs_only_the_damaged_records():
    draw = random.Random(1)
    payloads = [bytes(draw.getrandbits(8) for _ in range(draw.randint(0, 3000))) + b"text " * draw.randint(0, 200) for _ in range(12)]
    for packed in (True, False):
        for _ in range(150):
            data, places = archive(payloads, packed)
            hurt = draw.randrange(len(payloads))
            a, b = places[hurt]
            kind = draw.choice(["flip", "zero", "cut", "insert", "head"])
            at = draw.randrange(a + 1, b - 4)
            if kind == "flip":
                data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
            elif kind == "zero":
                data = data[:at] + bytes(min(40, b - at)) + data[at + min(40, b - at) :]
            elif kind == "cut":
                data = data[:at] + data[min(b, at + 30) :]
            elif kind == "insert":
                data = data[:a] + b"\x1f\x8b\x08 rubbish WARC/1.1 rubbish" + data[a:]
            else:
                data = data[:a] + b"xx" + data[a + 2 :]
            found = list(warc.salvage(data))
            got = [f.payload for f in found if isinstance(f, warc.Record)]
            rest = payloads[:hurt] + payloads[hurt + 1 :]
            assert got in (rest, payloads), (packed, kind)
            gaps = [f for f in found if isinstance(f, warc.Gap)]
            assert got == payloads or gaps, (packed, kind)
            for f, g in zip(found, found[1:]):
                assert f.end <= g.begin
    truncated = archive(payloads)[0][:-100]
    found = list(warc.salvage(truncated))
    assert isinstance(found[-1], warc.Gap) and found[-1].end == len(truncated)
    assert [f.reason for f in warc.salvage(b"not an archive")] == ["no version line"]


def test_round_trip(spark):
    pages = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/ä b", "other"), (4, "u", None), (5, "u", ""), (7, "u\r\nX: y", "long" * 100000), (None, "u", "same"), (0, "u", "same"), (3, "http://a/ä b", "other")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    folder = run_folder(spark, "test-archives")
    warc.write(df, folder)
    rows = warc.resolved(warc.read(spark, folder)).collect()
    assert len(rows) == len(pages) and all(r.kind == "record" for r in rows)
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r.record_id.split(":")[2], []).append(r)
    for page_id, _, html in pages:
        data = (html or "").encode()
        for r in by_id["None" if page_id is None else str(page_id)]:
            assert r.payload_bytes == len(data)
            assert r.payload_sha1 == r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kinds = {k: v[0].record_type for k, v in by_id.items()}
    assert kinds == {"0": "response", "1": "revisit", "2": "revisit", "3": "response", "4": "response", "5": "revisit", "7": "response", "None": "response"}
    assert by_id["1"][0].refers_to.startswith("urn:page:0:") and len(by_id["3"]) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = run_folder(spark, "test-archives")
    warc.write(df, folder)
    assert warc.read(spark, folder).count() == 0
