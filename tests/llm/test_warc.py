"""Archives: exact round trips through index and byte ranges."""

import hashlib

from labelflow.llm import warc

PAGES = [
    (1, "http://a/", "x" * 1500), (2, "http://b/", "x" * 1500), (7, "http://c/", "x" * 1500), (3, "http://d/", "y" * 999), (4, "http://e/", "y" * 999),
    (5, None, None), (6, "http://é/\r\nWARC-Type: evil", "\r\n\r\nWARC/1.1\r\n\r\nhé\r\n\r\n"), (8, "http://f/", ""), (None, "http://g/", "x" * 1500),
    (9, "http://h/", "é" * 500), (10, "http://i/", "é" * 500), (11, "http://j/", "z" * 3_000_000),
]


def archive(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(3, "page_id")
    warc.write(df, f"file://{tmp_path}/warc")
    return warc.build_index(spark, f"file://{tmp_path}/warc", f"file://{tmp_path}/index")


def test_round_trip(spark, tmp_path):
    index = archive(spark, tmp_path, PAGES)
    rows = {r["page_id"]: r for r in warc.read(index).collect()}
    assert len(rows) == len(PAGES)
    refers = {1: 7, 2: 7, None: 7, 9: 10}
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        r = rows[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r["refers_to"] == refers.get(page_id)
        assert r["record_type"] == ("revisit" if page_id in refers else "response")
        assert bytes(r["payload"]) == (b"" if page_id in refers else payload)


def test_index_gives_exact_places(spark, tmp_path):
    for r in archive(spark, tmp_path, PAGES).collect():
        data = open(r["file"].removeprefix("file:").replace("//", "/"), "rb").read()[r["offset"] : r["offset"] + r["length"]]
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_selection_reads_only_what_was_asked(spark, tmp_path):
    index = archive(spark, tmp_path, PAGES)
    assert sorted(r["page_id"] for r in warc.read(index.where("page_id in (6, 8, 11)")).collect()) == [6, 8, 11]


def test_near_ranges_become_one_read():
    rows = [{"file": f, "offset": o, "length": n} for f, o, n in [("a", 0, 10), ("a", 10, 10), ("a", 50_000, 10), ("a", 10_000_000, 5), ("b", 0, 5)]]
    assert [len(run) for run in warc._ranges(iter(rows))] == [3, 1, 1]


def test_empty_table(spark, tmp_path):
    assert warc.read(archive(spark, tmp_path, [])).collect() == []
