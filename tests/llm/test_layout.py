"""Packing, media, sharding: round trips and exact laws."""

import collections
import hashlib
import random
import struct
import zlib

from tests.llm.common_cases import documents, frame
from tidewater.llm import media, packing, sharding


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_covers_every_id_once(spark):
    rows = packing.pack_documents(frame(spark), window=128, with_ids=True).collect()
    expected = collections.Counter((i, tuple(ids_of(t))) for i, t in documents())
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= 128
        by_doc[r.doc_id].append(r)
    for (doc, ids), copies in expected.items():
        parts = [r for r in by_doc[doc] if r.doc_tokens == len(ids)]
        held = collections.Counter((r.start, struct.unpack(f"<{r.length}I", r.ids)) for r in parts)
        at = 0
        while at < len(ids):
            piece = next(p for s, p in held if s == at and p == ids[at : at + len(p)])
            assert held[at, piece] >= copies
            at += len(piece)
    for pieces in _by(rows, lambda r: r.sequence_id).values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128


def test_equal_rows_are_packed_in_many_groups(spark):
    cut = packing.pieces(frame(spark, [(None, "one text that comes again and again")] * 900 + [(1, "x")] * 300), 32)
    once, again = (sorted((tuple(r) for r in packing.pack(cut, 1200, 32, 100).collect()), key=repr) for _ in range(2))
    per_group = collections.Counter(r[5] >> 32 for r in once)
    assert once == again and len(once) == 1200 and len(per_group) == 12 and max(per_group.values()) <= 110


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 33) for _ in range(120)), reverse=True)
        got = packing.best_fit(lengths, 32)
        rooms: list[int] = []
        for length, sequence, offset in zip(lengths, *got, strict=True):
            fits = [r for r in rooms if r >= length]
            if fits and length < 32:
                assert rooms[sequence] == min(fits) and offset == 32 - min(fits)
            else:
                assert sequence == len(rooms) and offset == 0
                rooms.append(32)
            rooms[sequence] -= length
    free = packing.OpenWindows(32)
    assert free.take(1) is None
    free.push(32, 0)
    assert free.take(32) == (32, 0) and free.take(1) is None


def test_encoder_equals_the_vocabulary():
    encode = packing.Encoder(packing.vocabulary())
    for text in ["a  b \n c", " x", "x ", "日本 語 text's", "\n\n a", " ", "é é<|endoftext|>", "don't  WON'T 123 4,5", "a b", "\x1c x"]:
        assert list(struct.unpack(f"<{len(encode(text)) // 4}I", encode(text))) == ids_of(text)[:-1]


def test_media_round_trip(spark):
    rows = media.media_digests(frame(spark)).collect()
    assert len(rows) == len(documents())
    texts = collections.defaultdict(set)
    for i, t in documents():
        texts[i].add((t or "").encode())
    for r in rows:
        raw = next(x for x in texts[r.doc_id] if len(x) == r.n_bytes)
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert r.payload_bytes == len(padded) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes % 188 == 0 and "errors=0" in r.feature
        assert r.first_pts == 0 and r.entry_pts[0] == 0 and r.last_pts >= r.entry_pts[-1] and r.last_pts == media.UNIT_TICKS * ((len(padded) - 1) // media.UNIT_BYTES)


def test_media_is_a_table_of_streams(spark):
    stored = media.encode_documents(frame(spark)).cache()
    parsed = {r.doc_id: r for r in media.parse_streams(stored.where("doc_id = 67")).collect()}[67]
    units = parsed.units
    assert parsed.errors == 0 and parsed.programs == 1
    assert [u.pts for u in units] == [media.UNIT_TICKS * k for k in range(len(units))]
    assert [u.random_access for u in units] == [k % media.GOP == 0 for k in range(len(units))]
    text = dict(documents())[67].encode()
    assert b"".join(bytes(u.bytes) for u in units).rstrip(b"\0") == text


def test_media_finds_damage():
    payload = bytes(range(256)) * 256
    stream = media.mux(payload)
    whole = media.demux(stream)
    assert b"".join(u[3] for u in whole["units"]) == payload and whole["errors"] == 0
    lost = media.demux(stream[: 188 * 10] + stream[188 * 11 :])
    assert lost["errors"] >= 1
    flipped = bytearray(stream)
    flipped[10] ^= 1  # in the program table
    assert media.demux(bytes(flipped))["errors"] >= 1
    assert media.demux(None)["units"] == [] and media.demux(b"x" * 400)["errors"] > 0
    repeated = media.demux(stream[: 188 * 5] + stream[188 * 4 : 188 * 5] + stream[188 * 5 :])
    assert b"".join(u[3] for u in repeated["units"]) == payload


def test_reading_goes_on_after_lost_bytes():
    payload = random.Random(3).randbytes(200_000)
    stream = media.mux(payload)
    whole = media.demux(stream)
    assert b"".join(u[3] for u in whole["units"]) == payload and whole["errors"] == 0
    assert [c for _, c in whole["clocks"]] == [u[1] for u in whole["units"] if u[2]] and {p for p, _ in whole["clocks"]} == {media.DATA_PID}
    for cut in ((5_000, 5_077), (100_003, 101_000), (188 * 40, 188 * 40 + 1)):
        hurt = media.demux(stream[: cut[0]] + stream[cut[1] :])
        good = {u[1]: u[3] for u in whole["units"]}
        assert hurt["errors"] >= 1 and sum(good.get(u[1]) == u[3] for u in hurt["units"]) >= len(good) - 2
    noise = media.demux(b"\x47noise" * 20 + stream)
    assert b"".join(u[3] for u in noise["units"]) == payload and noise["errors"] >= 1


def test_tables_over_several_packets():
    """A program table of 60 programs, whose section takes two packets, and a map that follows another section."""
    entries = b"".join(bytes([0, k + 1, 0xE0 | (media.MAP_PID + k) >> 8, (media.MAP_PID + k) & 0xFF]) for k in range(60))
    section = media._section(0x00, 1, entries)
    head = lambda pid, starts, counter: bytes([media.SYNC, (0x40 if starts else 0) | pid >> 8, pid & 0xFF, 0x10 | counter])
    first = head(0, True, 0) + b"\0" + section[:183]
    second = (head(0, False, 1) + section[183:]).ljust(188, b"\xff")
    mapped = media.TABLES[media.PACKET :]
    data = media.mux(b"payload!" * 8)[2 * media.PACKET :]
    parsed = media.demux(first + second + mapped + data)
    assert parsed["programs"] == 60 and parsed["errors"] == 0 and parsed["units"][0][3] == b"payload!" * 8
    assert media.demux(first + mapped + data)["units"] == []


def test_sharding_law(spark):
    many = documents() + [(100 + i, "one text that very many documents share") for i in range(60)]
    rows = sharding.shard_documents(frame(spark, many), shards=6).collect()
    assert len(rows) == len(many)
    shards = _by(rows, lambda r: r.shard)
    sizes = [len(v) for v in shards.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 1
    for v in shards.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in many)
    assert want == collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    # nearly all texts lie in one shard, and the large one is less spread than by chance
    cut = 0
    for group in _by([r for r in rows if r["size"] > 8], lambda r: r.text_crc32).values():
        held = collections.Counter(r.shard for r in group)
        cut += len(held) - 1 if len(group) < 10 else 0
        assert len(group) < 10 or sum(n * n for n in held.values()) > 0.25 * len(group) ** 2
    assert cut <= 3


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none).count() == 0
    assert media.media_digests(none).count() == 0
    assert sharding.shard_documents(none).count() == 0


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out
