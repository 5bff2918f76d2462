"""Archives: round trip, revisits, and salvage of damaged ones against what was left whole."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from boutframe.llm import warc
from boutframe.llm.catalogue import QUERIES
from boutframe.llm.tables import table

SCHEMA = "page_id long, url string, html string"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    first = {}
    for i in sorted(payloads):
        first.setdefault(payloads[i], i)
    return {
        i: (len(p), b32(p), *(("revisit", first[p]) if first[p] != i and len(p) >= least else ("response", None)))
        for i, p in payloads.items()
    }


def as_dict(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_whole_table(spark, root):
    rows = table(spark, root, "pages").collect()
    df = QUERIES["op1_warc_round_trip"](spark, root)
    assert df.count() == len(rows)
    assert as_dict(df) == expected(rows)


def test_odd_pages(spark, tmp_path):
    rows = [
        (1, "http://a/ b\r\nWARC-Type: x", None), (2, None, ""), (3, "u", "é\r\n\r\nWARC/1.1\r\n"), (4, "u", "x" * 200_000),
        (5, "u", "x" * 200_000), (6, "u", "\x1f\x8b\x08"), (9, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame([r + ("z",) for r in rows], SCHEMA + ", payload string")
    assert as_dict(warc.round_trip(pages, f"file://{tmp_path}/w")) == expected([dict(zip(("page_id", "url", "html"), r)) for r in rows])
    null_ids = spark.createDataFrame([(None, "u", "a"), (None, "u", "b"), (3, "u", "a"), (3, "u", "a")], SCHEMA)
    got = sorted(warc.round_trip(null_ids, f"file://{tmp_path}/n").collect(), key=str)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0),
    ]
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/e").collect() == []


def test_small_payloads_are_all_responses_below_the_bound(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], SCHEMA)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", least_bytes=4)
    kinds = {r["record_id"]: r["record_type"] for r in warc.read_archives(manifest).collect()}
    assert [kinds[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


def test_archives_roll_and_hold_whole_payloads(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    assert manifest.count() > 10
    got = {r["target_uri"]: bytes(r["payload"]) for r in warc.read_archives(manifest).collect()}
    assert got == {u: t.encode() for _, u, t in rows}


def records(n, seed=0):
    rng = random.Random(seed)
    return [warc.record(str(i), f"http://x/{i}", rng.randbytes(rng.randrange(3000)), None) for i in range(n)]


def scan(data):
    return list(warc.scan(warc.Source(io.BytesIO(data), len(data))))


def ids(found):
    return [f.headers["warc-record-id"] for f in found if f.reason is None]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_salvage(packed, seed):
    """Whatever one damage hits, every record outside it is recovered and the gap covers it."""
    rng = random.Random(seed)
    parts = [warc.compress(r) if packed else r for r in records(30, seed)]
    starts = [sum(map(len, parts[:k])) for k in range(31)]
    data = bytearray(b"".join(parts))
    if packed:
        assert len(gzip.decompress(bytes(data))) == sum(map(len, records(30, seed)))
    a = rng.randrange(len(data))
    b = min(len(data), a + rng.choice([1, 3, 40, 5000]))
    kind = seed % 3
    if kind == 0:  # overwrite
        data[a:b] = bytes(x ^ 0x55 for x in data[a:b])
    elif kind == 1:  # cut out
        del data[a:b]
    else:  # insert junk
        data[a:a] = rng.randbytes(500) + b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + warc.MEMBER
        b = a
    found = scan(bytes(data))
    whole = [f"<urn:page:{k}>" for k in range(30) if starts[k + 1] <= a or starts[k] >= b]
    assert set(whole) <= set(ids(found))
    # Records and gaps tile the archive.
    assert [f.start for f in found] == [0, *[f.end for f in found[:-1]]]
    assert found[-1].end == len(data)
    assert any(f.reason for f in found) or kind == 1


def test_truncated_and_foreign_files():
    data = b"".join(map(warc.compress, records(5)))
    found = scan(data[:-10])
    assert len(ids(found)) == 4 and found[-1].reason == "truncated member"
    assert scan(b"") == []
    assert [(f.start, f.end, f.reason) for f in scan(b"hello world")] == [(0, 11, "no version line")]
    assert [f.reason for f in scan(warc.compress(b"no archive"))] == ["member without a version line"]


def test_member_of_several_records():
    """Records that share a member are all read, before and after members of their own."""
    r = records(8)
    data = warc.compress(b"".join(r[:3])) + warc.compress(r[3]) + warc.compress(r[4]) + warc.compress(b"".join(r[5:]))
    found = scan(data)
    assert ids(found) == [f"<urn:page:{k}>" for k in range(8)] and not any(f.reason for f in found)
    unpacked = b"".join(r[:3])
    assert [unpacked[slice(*f.inner)] for f in found[:3]] == r[:3]
    assert {(f.start, f.end) for f in found[:3]} == {(0, len(warc.compress(unpacked)))}
    assert [f.payload for f in found] == [f.payload for f in scan(b"".join(r))]


def test_damage_inside_a_whole_member():
    r = records(9)
    broken = bytearray(r[4])
    broken[-20] ^= 0xFF
    data = warc.compress(b"".join([*r[:4], bytes(broken), *r[5:]]))
    found = scan(data)
    assert ids(found) == [f"<urn:page:{k}>" for k in range(9) if k != 4]
    (gap,) = [f for f in found if f.reason]
    before = sum(map(len, r[:4]))
    assert gap.inner == (before, before + len(r[4])) and gap.reason == "warc-block-digest differs"
    junk = scan(warc.compress(b"junk" * 1000 + r[0] + b"tail"))
    assert [(f.reason, f.inner) for f in junk] == [
        ("member without a version line", (0, 4000)), (None, (4000, 4000 + len(r[0]))), ("no version line", (4000 + len(r[0]), 4004 + len(r[0]))),
    ]


@pytest.mark.parametrize("seed", range(8))
def test_a_large_member_breaks_off(seed):
    """Records before the damage are kept, those of the next members found, the rest is one gap."""
    rng = random.Random(seed)
    r = [warc.record(str(i), None, rng.randbytes(rng.randrange(60_000)), None) for i in range(40)]
    one = warc.compress(b"".join(r[:30]))
    cut = rng.randrange(len(one) // 4, len(one))
    ends = [sum(map(len, r[: k + 1])) for k in range(30)]
    unpack = warc.zlib.decompressobj(31)
    reach = len(unpack.decompress(one[:cut]))
    data = one[:cut] + b"".join(map(warc.compress, r[30:]))
    found = scan(data)
    assert set(ids(found)) == {f"<urn:page:{k}>" for k in range(40) if k >= 30 or ends[k] <= reach}
    (gap,) = [f for f in found if f.reason]
    assert gap.start <= cut <= gap.end and gap.end == cut


def test_a_member_is_unpacked_in_bounded_memory():
    import tracemalloc

    r = [warc.record(str(i), None, bytes(200_000), None) for i in range(400)]  # 80 MB of zeros
    data = warc.compress(b"".join(r))
    del r
    tracemalloc.start()
    n = sum(1 for f in warc.scan(warc.Source(io.BytesIO(data), len(data))) if not f.reason)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 400 and peak < 12 << 20


def test_records_without_digests_need_a_whole_member():
    plain = warc.VERSION + b"\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    member = warc.compress(plain * 2)
    assert len([f for f in scan(member) if not f.reason]) == 2
    spoiled = member[:-8] + bytes(x ^ 1 for x in member[-8:])
    assert [(f.start, f.end, f.reason) for f in scan(spoiled)] == [(0, len(member), "bad member")]
    proven = warc.compress(records(1)[0])
    kept = scan(proven[:-8] + bytes(8))
    assert ids(kept) == ["<urn:page:0>"] and kept[-1].reason == "bad member" and kept[-1].end == len(proven)


def test_gap_is_logged_by_the_job(spark, tmp_path):
    parts = [warc.compress(r) for r in records(6)]
    broken = bytearray(b"".join(parts))
    middle = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
    broken[middle] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(broken)
    (tmp_path / "empty.warc").write_bytes(b"")
    archives = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc.gz", "empty.warc")], "path string")
    got = warc.read_archives(archives).collect()
    gaps = [r for r in got if r["gap_reason"]]
    assert len(got) - len(gaps) == 5 and len(gaps) == 1
    assert (gaps[0]["start"], gaps[0]["end"]) == (len(parts[0] + parts[1]), len(b"".join(parts[:3])))
