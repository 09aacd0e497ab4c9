"""Records that cross line ends, from any cut of a file, against Python's CSV reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from labelflow.sources import imports, quoted_lines


def random_file(source, records, ends=("\n", "\r\n", "\r")):
    """Well-formed records whose cells hold quotes, commas and line ends; some quotes stand inside unquoted cells."""
    end, lines = source.choice(ends), []
    for _ in range(records):
        cells = []
        for _ in range(3):
            value = "".join(source.choice('ab,"\n\r é') for _ in range(source.randint(0, 6)))
            plain = not set(value) & set(',"\n\r')
            cells.append(source.choice([value, value + '5"']) if plain and value.strip() else '"' + value.replace('"', '""') + '"')
        lines.append(",".join(cells))
    return "a,b,c" + end + end.join(lines) + source.choice(["", end])


def parsed(text):
    """Rows by Python's reader; one whose cells are all empty is no record."""
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [tuple(r) for r in rows[1:] if any(r)]


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_gives_the_same_records(spark, tmp_path, monkeypatch, seed):
    source = random.Random(seed)
    texts = {f"{k}.csv": random_file(source, source.randint(0, 40)) for k in range(5)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    monkeypatch.setattr(quoted_lines.pieces, "__defaults__", (source.choice([1, 20, 100, 10**6]),))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = imports.csv_source(spark, [str(tmp_path)], multi_line=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = imports.import_files(found).rows.orderBy("__record_id").collect()
    assert [r["__record_id"] for r in rows] == list(range(1, len(rows) + 1))
    wanted = [(name, *row) for name in sorted(texts) for row in parsed(texts[name])]
    assert [(r["__source_file"], r["a"], r["b"], r["c"]) for r in rows] == wanted


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    lines = "".join(f'{k},"first\nsecond, ""{k}""\n",{"x" * (k % 50)}\n' for k in range(5000))
    (tmp_path / "one.csv").write_text("n,text,pad\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        source = imports.csv_source(spark, [str(tmp_path / "one.csv")])
        assert not source.profiles.first()["line_safe"] and source.profiles.first()["row_count"] == 5000
        pieces = quoted_lines.pieces(spark, [str(tmp_path / "one.csv")], F.lit("one").alias("file_path"))
        assert len(pieces.inputFiles()) > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert source.cells.select("block").distinct().count() > 8
    rows = imports.import_files(source, start=7).rows.collect()
    got = {r["__record_id"]: (r["n"], r["text"], len(r["pad"])) for r in rows}
    assert got == {k + 7: (str(k), f'first\nsecond, "{k}"\n', k % 50) for k in range(5000)}


@pytest.mark.parametrize("line, out, inside", [
    ("", False, True),
    ("a,b", False, True),
    ('"a', True, False),
    ('a"b', False, False),
    ('a","b', True, True),
    ('"a""', True, False),
    ('"a"",', True, False),
    ('"a",b"c', False, False),
    (',"', True, False),
])
def test_state_after_a_line(line, out, inside):
    assert (quoted_lines.ends_inside(line, False), quoted_lines.ends_inside(line, True)) == (out, inside)


def test_a_quote_that_never_closes_takes_the_rest(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"four\nfive,6\n7,8\n')
    rows = imports.import_files(imports.csv_source(spark, [str(tmp_path)])).rows.orderBy("__record_id").collect()
    assert (rows[0]["a"], rows[0]["b"]) == ("1", "2")
    assert rows[1]["a"] == "3" and rows[1]["b"].startswith("four\nfive") and len(rows) == 2


def test_a_header_that_crosses_lines_and_empty_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted_lines.pieces, "__defaults__", (1,))
    (tmp_path / "head.csv").write_text('\n"long\nname",b\n"x\ny",2\n')
    (tmp_path / "none.csv").write_text('"long\nname",b')
    imported = imports.import_files(imports.csv_source(spark, [str(tmp_path / n) for n in ("none.csv", "head.csv")], multi_line=True))
    assert imported.columns == ["long\nname", "b"]
    assert [tuple(r)[3:] for r in imported.rows.collect()] == [("x\ny", "2")]
