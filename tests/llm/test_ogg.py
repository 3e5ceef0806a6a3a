"""Ogg columns: exact round trips, checksums, damage, spanning packets."""

import hashlib
import random
import zlib

import pytest

from pushgraph.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_checksum(n):
    data = random.Random(n).randbytes(n)
    assert ogg.page_checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [192, 384, 4608, 4800, 9216, 13824, 192 * 5000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.encode(payload)
    got, facts = ogg.decode(media)
    assert got == payload
    assert facts["bad"] == facts["stray"] == facts["lost"] == 0 and facts["streams"] == 2 and facts["samples"] == n
    assert all(s.ended for s in ogg.demultiplex(media)[0].values())


def test_lacing_of_spanning_packets():
    w = ogg.StreamWriter(7, segments=3)
    packets = [bytes([i]) * n for i, n in enumerate((0, 255, 2000, 10, 765))]
    media = b"".join(w.packet(p, i + 1, last=i == 4) for i, p in enumerate(packets))
    streams, bad, stray = ogg.demultiplex(media)
    assert [p.data for p in streams[7].packets] == packets and not bad and not stray and streams[7].ended


def test_damage_is_found():
    payload = random.Random(5).randbytes(192 * 300)
    media = bytearray(ogg.encode(payload))
    media[len(media) // 2] ^= 1
    got, facts = ogg.decode(bytes(media))
    assert got is None and facts["bad"] >= 1 and facts["lost"] >= 1
    assert ogg.decode(b"junk")[0] is None and ogg.decode(b"")[0] is None
    got, facts = ogg.decode(b"xx" + ogg.encode(payload) + b"OggS")
    assert got == payload and facts["stray"] == 6


def test_columns(spark):
    texts = ["", None, "a" * 192, "é" * 100, "x" * 100_000, "a" * 192]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes")
    got = {r["doc_id"]: r for r in ogg.media_columns(ogg.to_ogg(df)).collect()}
    assert len(got) == 6
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(ogg.encode(payload)).hexdigest()
    assert got[2][2:] == got[5][2:] and got[0][1:] == got[1][1:]


def test_empty_and_null(spark):
    assert ogg.media_columns(ogg.to_ogg(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    r = ogg.media_columns(spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")).first()
    assert r["payload_sha256"] is None and r["feature"] == "streams=0"


def test_chained_streams_and_cut_packets():
    first, second = random.Random(1).randbytes(192 * 40), random.Random(2).randbytes(192 * 30)
    streams, bad, stray = ogg.demultiplex(ogg.encode(first) + ogg.encode(second))
    assert len(streams) == 4 and not bad and not stray and all(s.ended and not s.lost for s in streams.values())
    for chain, payload in ((0, first), (1, second)):
        link = [s for n, s in streams.items() if n // ogg.CHAIN == chain]
        assert sum(len(p.data) for s in link for p in s.packets[1:]) == len(payload)
    # A packet of several pages of which the last is missing, and the next page starts anew.
    w = ogg.StreamWriter(9, segments=2)
    pages = w.packet(b"a" * 2000, 1) + w.packet(b"b" * 10, 2, flush=True)
    ends = [i for i in range(len(pages)) if pages.startswith(ogg.CAPTURE, i)] + [len(pages)]
    kept, number = b"", 0
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if i in (0, 1, len(ends) - 2):
            page = bytearray(pages[a:b])
            page[5] &= ~ogg.CONTINUED if i == len(ends) - 2 else 255
            page[18:26] = number.to_bytes(4, "little") + bytes(4)
            page[22:26] = ogg.page_checksum(bytes(page)).to_bytes(4, "little")
            kept, number = kept + bytes(page), number + 1
    streams, bad, _ = ogg.demultiplex(kept)
    assert not bad and streams[9].lost == 1 and streams[9].packets[-1].data.endswith(b"b" * 10)
