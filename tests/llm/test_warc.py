import hashlib

import numpy as np
import pytest

from quern.llm import warc

BIG, SMALL = "x" * 1000, "y" * 999
PAGES = [
    (1, "http://a/1", BIG, "e"), (2, "http://a/2\r\nX-Evil: 1", BIG, "e"), (3, None, BIG, "e"), (4, "http://a/4", SMALL, "e"), (5, "http://a/5", SMALL, "e"),
    (6, "u", None, "e"), (7, "u", "", "e"), (8, "u", "WARC/1.1\r\n\r\n" * 200, "e"), (9, "u", "é\n" * 600 + "\r\n\r\n", "e"), (10, "u", "long " * 400_000, "e"), (None, "u", BIG, "e"), (3, None, BIG, "e"),
]


def archived(spark, pages, path, **options):
    table = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string")
    warc.write_archives(warc.resolve_revisits(warc.responses(table, "page_id", "url", "html"), **options), path)
    return warc.read_archives(spark, path)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_records_come_back_with_revisits_resolved(spark, tmp_path, broadcast_rows):
    rows = archived(spark, PAGES, f"{tmp_path}/a", broadcast_rows=broadcast_rows).collect()
    assert len(rows) == len(PAGES)
    texts = {}
    for page_id, _, html, _ in PAGES:
        texts[page_id] = html or ""
    for r in rows:
        payload = texts[r["record_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = r["record_id"] in (1, 2, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
    assert [r["target_uri"] for r in rows if r["record_id"] == 2] == ["http://a/2 X-Evil: 1"]


def test_archives_are_deduplicated_again_across_archives(spark, tmp_path):
    first = [(i, f"u{i}", BIG, "e") for i in (1, 2)]
    archived(spark, first, f"{tmp_path}/in/a")
    archived(spark, [(7, "u7", BIG, "e"), (8, "u8", SMALL, "e")], f"{tmp_path}/in/b")
    for name in ("a", "b"):
        assert warc.read_archives(spark, f"{tmp_path}/in/{name}").count() == 2
    warc.deduplicated_archives(spark, f"{tmp_path}/in/*", f"{tmp_path}/out")
    got = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"{tmp_path}/out").collect())
    assert got == [(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (8, "response", None)]


def test_several_archives_and_an_empty_table(spark, tmp_path):
    table = spark.range(25).selectExpr("id as page_id", "'u' as url", "concat('p', id) as html").coalesce(1)
    warc.write_archives(warc.resolve_revisits(warc.responses(table, "page_id", "url", "html")), f"{tmp_path}/a", records_per_archive=10)
    assert len(list((tmp_path / "a").glob("*.gz"))) == 3
    assert warc.read_archives(spark, f"{tmp_path}/a", with_payload=False).count() == 25
    empty = archived(spark, [], f"{tmp_path}/b")
    assert empty.count() == 0


def test_links_to_other_archives_stay(spark, tmp_path):
    """A revisit of a response that is not there, with names and a payload that other writers give."""
    import base64
    import gzip

    payload = b"\xff\xfe not text " * 100
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)

    def record(kind, name, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-02T03:04:05Z", *more, f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(head).encode() + block + b"\r\n\r\n"

    folder = tmp_path / "in"
    folder.mkdir()
    far = ("WARC-Refers-To: <urn:uuid:far>", "WARC-Refers-To-Target-URI: http://far/", "WARC-Refers-To-Date: 2019-01-01T00:00:00Z")
    records = [record("warcinfo", "i", b"x"), record("revisit", "r1", http, "WARC-Payload-Digest: sha1:" + "A" * 32, *far), record("response", "p1", http + payload, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://p1/"), record("response", "p2", http + payload)]
    (folder / "other.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    warc.deduplicated_archives(spark, str(folder), f"{tmp_path}/out")
    rows = {r["record_name"]: r for r in warc.read_archives(spark, f"{tmp_path}/out").collect()}
    r1, p1, p2 = (rows[f"urn:uuid:{n}"] for n in ("r1", "p1", "p2"))
    assert (r1["record_type"], r1["refers_to_name"], r1["refers_to_uri"], r1["refers_to_date"]) == ("revisit", "urn:uuid:far", "http://far/", "2019-01-01T00:00:00Z")
    assert p2["record_type"] == "response" and bytes(p2["payload"]) == payload and p2["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert (p1["record_type"], p1["refers_to_name"], p1["target_uri"]) == ("revisit", "urn:uuid:p2", "http://p1/")


def test_archives_are_bounded_by_bytes_and_hold_a_member_a_record(spark, tmp_path):
    import gzip
    import zlib

    sizes = [10, 900, 4_000, 70_000, 100, 20, 3_900, 64_000, 200_000]
    table = spark.createDataFrame([(i, f"u{i}", "z" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.resolve_revisits(warc.responses(table, "page_id", "url", "html")), f"{tmp_path}/a", archive_bytes=80_000, records_per_archive=20)
    files = list((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) >= 3 and not list((tmp_path / "a").glob("*.txt"))
    for file in files:
        members, packed = [], file.read_bytes()
        while packed:
            one = zlib.decompressobj(31)
            members.append(one.decompress(packed))
            packed = one.unused_data
        assert all(m.startswith(b"WARC/1.1\r\n") for m in members[::2]) and all(m == b"\r\n\r\n" for m in members[1::2])
        payloads = [m.rpartition(b"\r\n\r\n")[2] for m in members[::2]]
        assert sum(map(len, payloads)) <= 80_000 or len(payloads) == 1
        assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1") == len(payloads)
    assert sorted(r["payload_bytes"] for r in warc.read_archives(spark, f"{tmp_path}/a").collect()) == sorted(sizes)


def test_archives_are_filled_up_to_their_size():
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(1, 60, 300).tolist(), 99, 100, 101, 350, 401, 1, 5_000, 1, *rng.integers(1, 900, 100).tolist()]
    packer, rows = warc.Packer(400, 28), []
    for i, size in enumerate(sizes):
        rows += packer.add(b"%d " % i, size)
    rows += packer.close()
    held = [[int(x) for x in row.replace(warc.BETWEEN, b"").split()] for row in rows]
    assert sum(held, []) == list(range(len(sizes)))
    assert all(len(own) == 1 or sum(sizes[x] for x in own) <= 400 and len(own) <= 28 for own in held)
    assert all(len(a) == 28 or sum(sizes[x] for x in a) + sizes[b[0]] > 400 for a, b in zip(held, held[1:], strict=False))
