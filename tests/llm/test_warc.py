"""WARC archives: exact round trip."""

import gzip
import os
import random

from carledger.llm import warc
from carledger.session import shared_path

PAGE = "page_id long, url string, html string"


def test_round_trip(spark):
    rng = random.Random(8)
    pages = [(i, f"http://x/{i}", rng.choice(["<p>é</p>", "", None, "a\r\n\r\nb", f"own {i}", "WARC/1.1\r\n"])) for i in range(300)]
    pages += [(1000, "http://x/ü y\nz", "big " * 500_000), (1001, None, "no url"), (None, "http://n", "no id"), (None, "http://n", "no id"),
              (1002, "http://a", "twin"), (1002, "http://a", "twin"), (1003, "http://b", "twin")]
    rows = spark.createDataFrame([(*p, "x") for p in pages], PAGE + ", digest string").repartition(4)
    folder = shared_path(spark, "warc-test")
    index = warc.write(rows, folder)
    assert index.count() == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    got = warc.read(index, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        i = r["page_id"]
        html = next(h or "" for k, _, h in pages if k == i)
        b = html.encode()
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == warc.base32_sha1(b)
        other = first.get(html) not in (i, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if other else ("response", None))
        assert r["payload"] == (None if other else b)
    # The index gives each record's bytes; selected records are read alone.
    one = index.filter("page_id = 1000").first()
    with open(os.path.join(folder, one["file"]), "rb") as f:
        f.seek(one["offset"])
        record = gzip.decompress(f.read(one["length"]))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n")
    assert b"%0Az" in record.split(b"\r\n\r\n")[0]
    some = warc.read(index.filter("page_id % 7 = 0"), folder)
    assert some.count() == sum(p[0] is not None and p[0] % 7 == 0 for p in pages)
    digest = warc.round_trip(rows)
    assert digest.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and digest.count() == len(pages)
    assert warc.round_trip(rows.limit(0)).count() == 0


def test_ranges_merge_neighbours():
    row = lambda f, o, n: {"file": f, "offset": o, "length": n}
    rows = [row("a", 0, 10), row("a", 10, 5), row("a", 15 + warc.GAP_BYTES, 5), row("a", 10 ** 9, 5), row("b", 0, 4)]
    assert [(f, a, b, len(r)) for f, a, b, r in warc.ranges(iter(rows))] == [
        ("a", 0, 20 + warc.GAP_BYTES, 3), ("a", 10 ** 9, 10 ** 9 + 5, 1), ("b", 0, 4, 1)]
    far = [row("a", i * warc.READ_BYTES // 2, warc.READ_BYTES // 2) for i in range(5)]
    assert [len(r) for *_, r in warc.ranges(iter(far))] == [2, 2, 1]


def test_damaged_payload_is_an_error():
    import pytest
    good = warc.make_record(1, "u", b"abc", warc.base32_sha1(b"abc"), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"abc", b"abd"))
