import hashlib
import io
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tidelog.llm.queries import op3_warc
from tidelog.llm.shared import table
from tidelog.llm.warc import export_files, fetch, parse, read_records, record_index, write_bundles

ROWS = [
    (5, "http://a.example/x y\r\nz", "p" * 100, 1),
    (3, None, "p" * 100, 2),
    (3, None, "p" * 100, 2),
    (9, "u", "p" * 99, 3),
    (8, "u", "p" * 99, 4),
    (None, "u", "p" * 100, 5),
    (1, "u", None, 6),
    (2, "u", "", 7),
    (4, "ü", "é" * 300_000 + "\r\n\r\nWARC/1.1\r\n", 8),
    (7, "u", "\x00￿" * 60, 9),
]


def test_round_trip_revisits_and_index(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest long")
    bundles = write_bundles(pages, frame_bytes=200, bundle_bytes=600)
    got = read_records(bundles).collect()
    assert len(got) == len(ROWS)
    for rid, _, html, _ in ROWS:
        raw = (html or "").encode()
        for r in [r for r in got if r.record_id == (None if rid is None else str(rid))]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            if rid in (5, None):
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", "3", None)
            else:
                assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    index = {r.record_id: r for r in record_index(bundles).collect()}
    assert {(r.record_id, r.bundle, r.frame, r.offset) for r in got if r.record_id != "3"} == {(k, i.bundle, i.frame, i.offset) for k, i in index.items() if k != "3"}
    one = fetch(bundles, spark.createDataFrame([("4",), ("7",)], "record_id string")).collect()
    assert sorted(r.record_id for r in one) == ["4", "7"]
    for r in one:
        headers, n, payload, end = parse(bytes(r.record))
        assert len(payload) == n and end == len(r.record)

    files = export_files(bundles, str(tmp_path / "out")).collect()
    joined = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(f.file, "rb").read()), read_across_frames=True).read() for f in files)
    assert joined.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def test_empty(spark):
    assert read_records(write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


@pytest.mark.parametrize("rows", [[], ROWS, [(None, None, None, 1)], [(None, "u", "q" * 200, 1)] * 3, [(1, None, "é" * 50, 2)] * 3 + [(0, "u", "é" * 50, 1)]])
def test_query_on_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, repeated ids and rows, extra columns and empty tables, through the query itself."""
    spark.createDataFrame(rows, "page_id long, url string, html string, digest long").write.parquet(str(tmp_path / "pages.parquet"))
    ids = {}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        ids[raw] = min((x for x in (ids.get(raw), i) if x is not None), default=None)
    want = Counter()
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and ids[raw] is not None and ids[raw] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[raw] if again else None] += 1
    got = op3_warc(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_an_index_that_lies_is_an_error(spark):
    bundles = write_bundles(spark.createDataFrame(ROWS[:4], "page_id long, url string, html string, digest long"))
    wrong = bundles.withColumn("record_ids", F.reverse("record_ids"))
    with pytest.raises(Exception, match="the index has"):
        read_records(wrong).collect()


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, d, "pages").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    for r in op3_warc(spark, d).collect():
        raw = pages.pop(r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = len(raw) >= 100 and first[raw] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[raw]) if again else ("response", None))
    assert not pages
