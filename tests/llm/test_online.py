"""Packing with a bounded number of open bins: whole documents, exact ids, and the rule itself."""

import collections
import random
import struct
import zlib

from tests.llm.common_cases import documents, frame
from tidewater.llm import onlinefit, packing


def test_online_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    own, window = Tokenizer.from_file(packing.vocabulary()), 128
    docs = documents() + [(300, "a " * 127), (301, "a " * 126 + "a"), (302, "a " * 127 + "a")]
    rows = onlinefit.pack_documents(frame(spark, docs), window, with_ids=True, most_open=8, task_pieces=60).collect()
    want = collections.Counter()
    for doc, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % window or window
        cuts = [0, *range(first, len(ids), window), len(ids)] if len(ids) > window else [0, len(ids)]
        for k in range(len(cuts) - 1):
            want[doc, k, cuts[k], tuple(ids[cuts[k] : cuts[k + 1]])] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, struct.unpack(f"<{r.length}I", r.ids)) for r in rows)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_open_bins_follow_the_rule():
    rng = random.Random(4)
    for most in (1, 3, 1000):
        bins, rooms = onlinefit.OpenBins(40, most), {}
        for _ in range(500):
            length = rng.randrange(1, 41)
            at, offset = bins.place(length)
            fits = [room for room in rooms.values() if room >= length]
            if fits:
                assert rooms[at] == min(fits) and offset == 40 - min(fits)
            else:
                assert at not in rooms and offset == 0
            left = rooms.pop(at, 40) - length
            if left:
                rooms[at] = left
            if len(rooms) > most:  # the fullest goes
                tight = min(rooms.values())
                shut = [x for x in rooms if rooms[x] == tight and x not in bins.bins[tight]]
                assert len(shut) == 1
                del rooms[shut[0]]
            assert bins.open == len(rooms) <= most and bins.rooms == sum(1 << r for r in set(rooms.values()))


def test_little_is_padded():
    rng = random.Random(5)
    lengths = [rng.randrange(1, 1025) for _ in range(30_000)]
    bins = onlinefit.OpenBins(1024, onlinefit.MOST_OPEN)
    for n in lengths:
        bins.place(n)
    assert bins.begun <= 1.03 * sum(lengths) / 1024


def test_equal_rows_spread_and_repeat(spark):
    docs = frame(spark, [(None, "the same text")] * 400 + [(1, "x")] * 400)
    once, again = ([tuple(r) for r in onlinefit.pack_documents(docs, 16, task_pieces=100).collect()] for _ in range(2))
    assert sorted(once, key=repr) == sorted(again, key=repr) and len(once) == 800
    per_task = collections.Counter(r[5] >> 32 for r in once)
    assert len(per_task) == 9 and max(per_task.values()) <= 110


def test_nothing_to_pack(spark):
    assert onlinefit.pack_documents(frame(spark, [])).count() == 0
    assert [r.length for r in onlinefit.pack_documents(frame(spark, [(None, None), (3, "")])).collect()] == [1, 1]
