import struct

import pytest
import zstandard

from sparkrisk.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, data string, bundle int"


def test_bundle_is_a_seekable_zstandard_file():
    writer = W.BundleWriter()
    payloads = {f"urn:page:{i}": (b"%d " % i) * (50 + i * 37) for i in range(900)}
    for key, data in payloads.items():
        writer.add(key, W.record(key, "response", "http://x/ y\n", data, "00", len(data), None))
    whole = writer.finish()
    bundle = W.Bundle(whole)
    assert len(bundle.starts) > 3 and set(bundle.places) == set(payloads)
    for key in list(payloads)[::53]:
        assert bundle.read(key)[1] == payloads[key]
    # any Zstandard reader passes over the skippable frames; each frame stands alone
    joined = b"".join(bundle.frame(i) for i in range(len(bundle.starts)))
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == joined
    n, flags, magic = struct.unpack("<IBI", whole[-9:])
    assert (n, flags, magic) == (len(bundle.starts), 0, 0x8F92EAB1)


def test_one_record_needs_one_frame(monkeypatch):
    writer = W.BundleWriter()
    for i in range(100):
        writer.add(str(i), W.record(str(i), "response", "u", b"x" * 10_000, "0", 10_000, None))
    bundle, opened = W.Bundle(writer.finish()), []
    plain = bundle._plain
    bundle._plain = lambda data, **k: opened.append(len(data)) or plain(data, **k)
    bundle.read("57")
    assert len(opened) == 1


def test_damage_is_noticed():
    writer = W.BundleWriter()
    writer.add("a", W.record("a", "response", "u", b"x" * 500, "0", 500, None))
    data = bytearray(writer.finish())
    with pytest.raises(ValueError):
        W.Bundle(bytes(data[:-1]))
    data[20] ^= 255
    with pytest.raises(zstandard.ZstdError):
        W.Bundle(bytes(data)).read("a")


def test_odd_rows(spark):
    big = "same payload, over a hundred bytes " * 4
    rows = [(5, "http://a/", big), (3, None, big), (9, "http://b/ ü", big), (9, "http://b/", big), (4, "u", "short"), (2, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, "u", "null id, but long enough to be looked at as a possible copy " * 2),
            (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "é" * 49 + "a")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in W.read_records(W.archive(pages)).collect()), key=str)
    import hashlib
    want = []
    for p, _, html in rows:
        data = (html or "").encode()
        same = [q for q, _, h in rows if (h or "").encode() == data and q is not None]
        first = min(same) if len(data) >= 100 and same else p
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
    assert got == sorted(want, key=str)
    assert W.read_records(W.archive(pages.where("page_id > 99"))).count() == 0


def test_many_first_copies_are_joined_by_shuffle(spark, monkeypatch):
    import sparkrisk.llm.common as common
    monkeypatch.setattr(W, "small_side", lambda df: common.small_side(df, 0))
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('p', id % 10), 80) AS html")
    out = W.read_records(W.archive(pages)).collect()
    assert len(out) == 40 and all(r.refers_to == (None if r.page_id < 10 else r.page_id % 10) for r in out)
