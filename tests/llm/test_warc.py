from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib

from quern.llm import warc as W
from quern.llm.common import new_path
from quern.storage import Files

GOOD = [W.record(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * (i + 1)) + W.END for i in range(5)]


def kinds(data):
    return [(k, s, e) for k, s, e, _ in W.salvage(data)]


def covers(data):
    at = 0
    for _, s, e in kinds(data):
        assert s <= at
        at = max(at, e)
    assert at == len(data)


def test_whole_archives():
    data = b"".join(GOOD)
    found = list(W.salvage(data))
    assert [k for k, *_ in found] == ["record"] * 5
    assert [x[0]["warc-record-id"] for *_, x in found] == [f"<urn:page:{i}>" for i in range(5)]
    zipped = b"".join(gzip.compress(g) for g in GOOD)
    assert [k for k, *_ in W.salvage(zipped)] == ["record"] * 5
    assert list(W.salvage(b"")) == []


def test_damage_costs_one_record_and_is_logged():
    bad = bytearray(GOOD[2])
    bad[-20] ^= 1
    data = GOOD[0] + GOOD[1] + bytes(bad) + GOOD[3] + GOOD[4]
    found = list(W.salvage(data))
    assert [k for k, *_ in found] == ["record", "record", "gap", "record", "record"]
    gap = found[2]
    assert data[gap[1] : gap[2]] == bytes(bad) and gap[3] == "block digest differs"


def test_kinds_of_damage():
    for hurt, reason in (
        (GOOD[2].replace(b"Content-Length: ", b"Content-Length: 9"), None),
        (GOOD[2].replace(b"Content-Length: ", b"Content-Length: x"), "no content length"),
        (GOOD[2].replace(b"WARC/1.1", b"WORC/1.1"), "no version line"),
        (GOOD[2][:-40], None),
        (b"garbage \x00\xff" * 9, "no version line"),
        (GOOD[2].replace(b"WARC-Type: response", b"no colon here"), "malformed header line"),
    ):
        data = GOOD[0] + hurt + GOOD[3] + GOOD[4]
        found = list(W.salvage(data))
        assert [k for k, *_ in found] == ["record", "gap", "record", "record"], (reason, found)
        assert reason is None or found[1][3] == reason
        covers(data)


def test_zipped_damage():
    members = [gzip.compress(g) for g in GOOD]
    hurt = bytearray(members[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = members[0] + bytes(hurt) + b"\x1f\x8b\x08junk" + members[3] + members[4][:-9]
    found = list(W.salvage(data))
    assert [k for k, *_ in found] == ["record", "gap", "record", "record", "gap"]  # the last one was cut in its checksum
    covers(data)


def test_members_of_many_records():
    """A cut or damaged member gives all records that lie before the damage."""
    records = [W.record(i, f"http://h/{i}", random.Random(i).randbytes(3000)) + W.END for i in range(50)]
    whole = gzip.compress(b"".join(records))
    assert [k for k, *_ in W.salvage(whole)] == ["record"] * 50
    for share in (0.02, 0.5, 0.98):
        cut = whole[: int(share * len(whole))]
        found = list(W.salvage(cut))
        kept = sum(k == "record" for k, *_ in found)
        assert abs(kept - 50 * share) <= 1 and [k for k, *_ in found] == ["record"] * kept + ["gap"]
        assert [x[1] for k, *_, x in found if k == "record"] == [r[r.index(b"\r\n\r\n") + 4 : -4] for r in records[:kept]]
        after = list(W.salvage(cut + gzip.compress(GOOD[0])))
        assert [k for k, *_ in after] == ["record"] * kept + ["gap", "record"]
        covers(cut + gzip.compress(GOOD[0]))
    inside = gzip.compress(b"".join(records[:3]) + b"rubbish" + records[4])
    assert [k for k, *_ in W.salvage(inside)] == ["record"] * 4 + ["gap"]


def test_steps_change_nothing():
    """Bytes given in pieces have the events of the whole."""
    data = GOOD[0] + b"junk WARC/1.0\r\n" + GOOD[1] + GOOD[2][:-50] + GOOD[3] + b"tail"
    records = [x for k, *_, x in W.salvage(data) if k == "record"]
    for step in (1, 7, 64, 1000):
        held, seen = b"", []
        for at in range(0, len(data), step):
            held += data[at : at + step]
            rest = b""
            for k, s, e, x in W._plain(memoryview(held), at + step >= len(data)):
                if k == "record":
                    seen.append(x)
                elif k == "rest":
                    rest = held[s:e]
            held = rest
        assert seen == records


def test_every_run_gets_past_damage(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "test-warc")
    W.write(df, path, damage=3)
    found = W.read(spark, path).collect()
    hurt = sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(300))
    assert sum(r.gap is not None for r in found) == hurt > 50 and sorted(r.page_id for r in found if r.gap is None) == list(range(300))
    assert sorted(W.round_trip(df, damage=3).collect(), key=str) == sorted(W.round_trip(df, damage=0).collect(), key=str)
    for how in range(3):
        assert "record" not in [k for k, *_ in W.salvage(W.damaged(GOOD[1][:-4], how) + W.END)]


def test_random_damage_never_breaks_the_reader():
    rng = random.Random(3)
    for zipped in (False, True):
        parts = [gzip.compress(g) if zipped else g for g in GOOD]
        for _ in range(300):
            data = bytearray(b"".join(parts))
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(data))
                kind = rng.random()
                if kind < 0.4:
                    data[at] ^= 1 << rng.randrange(8)
                elif kind < 0.7:
                    del data[at : at + rng.randint(1, 60)]
                else:
                    data[at:at] = rng.randbytes(rng.randint(1, 30))
            covers(bytes(data))
            assert sum(k == "record" for k, _, _ in kinds(bytes(data))) >= 0


def test_payload_that_looks_like_records(spark):
    inside = GOOD[0] + b"WARC/1.1\r\n\r\n"
    df = spark.createDataFrame([(1, "http://x/\r\nEvil: y", inside.decode()), (2, None, "b")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in W.round_trip(df).collect()}
    assert len(rows) == 2 and rows[1].payload_bytes == len(inside)


def test_round_trip_and_revisits(spark):
    pages = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (3, "u3", "same"), (1, "u1", ""), (2, "u2", None), (None, "n", "same"), (None, "n", "alone é🙂"), (7, "u7", "x" * 300_000)]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, k int, d string").repartition(3)
    rows = W.round_trip(df).collect()
    first = {}
    for key, _, html in pages:
        b = (html or "").encode()
        if key is not None:
            first[b] = min(first.get(b, key), key)
    wanted = []
    for key, _, html in pages:
        b = (html or "").encode()
        f = first.get(b)
        response = f is None or key == f
        wanted.append((key, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else f))
    assert sorted(wanted, key=str) == sorted(map(tuple, rows), key=str)
    assert sorted(wanted, key=str) == sorted(map(tuple, W.round_trip(df, broadcast_rows=0).collect()), key=str)
    least = W.round_trip(df, least_bytes=1).collect()
    assert sorted(r.record_type for r in least if r.payload_bytes == 0) == ["response", "response"]
    assert W.round_trip(df.limit(0)).count() == 0


def test_gaps_reach_the_table(spark):
    path = new_path(spark, "test-warc")
    Files(spark).write(f"{path}/a.warc", GOOD[0] + b"rubbish" + GOOD[1])
    Files(spark).write(f"{path}/b.warc.gz", gzip.compress(GOOD[2]) + b"more rubbish")
    rows = W.read(spark, path).collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == [0, 1, 2]
    gaps = sorted((r.file.rsplit("/", 1)[-1], r.end - r.start) for r in rows if r.gap)
    assert gaps == [("a.warc", 7), ("b.warc.gz", 12)]
    assert {bytes(r.payload) for r in rows if r.page_id == 2} == {b"<p>page 2</p>" * 3}


def test_headers_of_any_length():
    for url in ("data:text/html," + "a" * 70_000, "http://h/" + "a b\t" * 60_000, "x" * 1_000_000):
        data = GOOD[0] + W.record(7, url, b"<p>long</p>") + W.END + GOOD[1]
        found = list(W.salvage(data))
        assert [k for k, *_ in found] == ["record"] * 3 and found[1][3][1].endswith(b"<p>long</p>")
    for at in range(65_480, 65_560):  # the blank line across the window's end
        data = W.record(7, "u" * (at - 300), b"y") + W.END
        assert [k for k, *_ in W.salvage(data)] == ["record"]
    lost = b"WARC/1.1\r\n" * 500 + b"no header " * 30_000
    assert [k for k, *_ in W.salvage(GOOD[0] + lost + GOOD[1])][0] == "record"


def test_a_page_with_a_very_long_url(spark):
    rows = [(1, "http://h/1", "<p>a</p>"), (2, "data:text/plain," + "é b" * 40_000, "<p>b</p>"), (3, None, "<p>c</p>")]
    found = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted(r.page_id for r in found) == [1, 2, 3]
