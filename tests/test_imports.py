import hashlib

import pytest
from pyspark.sql import functions as F

from labelflow.plans.fixtures import workbook_bytes
from labelflow.sources import headers, imports
from labelflow.sources.files import file_hashes, list_files


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding, newline="")
    return str(path)


def book(folder, name, rows, dimension=None):
    path = folder / name
    path.write_bytes(workbook_bytes(rows, dimension))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.orderBy("__record_id").drop("__batch_id").collect()]


def normalized(spark, cells):
    df = spark.createDataFrame([(cells,)], "c array<string>")
    return df.select(headers.normalize_headers(F.col("c")).alias("h")).first()["h"]


def test_headers_are_trimmed_and_made_unique(spark):
    assert normalized(spark, [" a ", "b", "a", None, "a", ""]) == ["a", "b", "a_2", "", "a_3", ""]
    assert normalized(spark, ["a", "a_2", "a"]) == ["a", "a_2", "a_3"]
    assert normalized(spark, ["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert normalized(spark, []) == []


def test_preflight_statuses(spark, tmp_path):
    paths = [
        write(tmp_path, "ok.csv", "摘要,年份,地区\na,2024,北京\n"),
        write(tmp_path, "reordered.csv", "地区,摘要,年份\n上海,b,2025\n"),
        write(tmp_path, "missing.csv", "摘要,年份\nc,2025\n"),
        write(tmp_path, "extra.csv", "摘要,年份,地区,行业\nd,2025,深圳,低空\n"),
        write(tmp_path, "both.csv", "摘要,年份,行业\nd,2025,低空\n"),
        write(tmp_path, "empty.csv", ""),
    ]
    report = imports.preflight(imports.csv_source(spark, paths))
    files = {r["file_name"]: r for r in report.files.collect()}
    assert {name: r["status"] for name, r in files.items()} == {
        "ok.csv": "matched", "reordered.csv": "reordered", "missing.csv": "missing_columns",
        "extra.csv": "extra_columns", "both.csv": "missing_columns", "empty.csv": "empty_header",
    }
    assert files["missing.csv"]["missing_columns"] == ["地区"] and files["extra.csv"]["extra_columns"] == ["行业"]
    assert (files["both.csv"]["missing_columns"], files["both.csv"]["extra_columns"]) == (["地区"], ["行业"])
    assert files["ok.csv"]["header_hash"] == hashlib.sha256("摘要\n年份\n地区".encode()).hexdigest()
    assert report.reference == ["摘要", "年份", "地区"]
    assert report.summary().first().asDict() == {"files": 6, "total_rows": 5, "can_import_strict": False}
    assert imports.preflight(imports.csv_source(spark, paths[:2])).summary().first()["can_import_strict"]


def test_import_aligns_reordered_columns(spark, tmp_path):
    first = write(tmp_path, "second.csv", "摘要,年份\na,2024\nb,2025\n", "utf-8-sig")
    second = write(tmp_path, "first.csv", "年份,摘要\n2026,c\n")
    imported = imports.import_files(imports.csv_source(spark, [first, second]))
    assert imported.columns == ["摘要", "年份"]
    assert rows(imported.rows) == [(1, "second.csv", "a", "2024"), (2, "second.csv", "b", "2025"), (3, "first.csv", "c", "2026")]
    ledger = {r["file_name"]: r for r in imported.ledger.collect()}
    assert ledger["second.csv"]["row_count"] == 2 and ledger["second.csv"]["status"] == "imported"
    assert ledger["second.csv"]["file_hash"] == hashlib.sha256((tmp_path / "second.csv").read_bytes()).hexdigest()
    assert len({r["batch_id"] for r in ledger.values()}) == 2


def test_import_refuses_or_reconciles_headers(spark, tmp_path):
    paths = [write(tmp_path, "a.csv", "x,y\n1,2\n"), write(tmp_path, "b.csv", "y,z\n3,4\n"), write(tmp_path, "c+ 1%.csv", "x,y,w\n5,6,7\n")]
    source = imports.csv_source(spark, paths)
    for options in [imports.ImportOptions(), imports.ImportOptions(allow_missing_columns=True)]:
        with pytest.raises(ValueError, match="b.csv"):
            imports.import_files(source, options=options)
    with pytest.raises(ValueError, match="c\\+ 1%.csv"):
        imports.import_files(imports.csv_source(spark, [paths[0], paths[2]]))
    both = imports.ImportOptions(allow_extra_columns=True, allow_missing_columns=True)
    imported = imports.import_files(source, options=both, start=11)
    assert imported.columns == ["x", "y", "z", "w"]
    assert rows(imported.rows) == [
        (11, "a.csv", "1", "2", "", ""), (12, "b.csv", "", "3", "4", ""), (13, "c+ 1%.csv", "5", "6", "", "7"),
    ]
    kept = imports.import_files(imports.csv_source(spark, paths[1:2]), reference=["x", "y", "z"], options=both)
    assert rows(kept.rows) == [(1, "b.csv", "", "3", "4")]


@pytest.mark.parametrize("multi_line", [None, True])
def test_csv_quoting_blank_rows_and_ragged_rows(spark, tmp_path, multi_line):
    text = 'a,"b, c",a\n"line\none","say ""hi""",3\n\n,,\n4\n5,6,7,8\n" s ",,\n'
    quoted = write(tmp_path, "quoted.csv", text)
    plain = write(tmp_path, "plain.csv", 'a,"b, c",a\n1,2,3\n,,\n')
    source = imports.csv_source(spark, [quoted, plain], multi_line)
    imported = imports.import_files(source)
    assert imported.columns == ["a", "b, c", "a_2"]
    assert rows(imported.rows) == [
        (1, "quoted.csv", "line\none", 'say "hi"', "3"), (2, "quoted.csv", "4", "", ""), (3, "quoted.csv", "5", "6", "7"),
        (4, "quoted.csv", " s ", "", ""), (5, "plain.csv", "1", "2", "3"),
    ]
    if multi_line is None:
        files = {r["file_name"]: r for r in imports.preflight(source).files.collect()}
        assert (files["quoted.csv"]["row_count"], files["quoted.csv"]["records"]) == (5, 4)
        assert (files["plain.csv"]["row_count"], files["plain.csv"]["records"]) == (2, 1)


def test_dense_ids_over_split_files(spark, tmp_path):
    text = "n,pad\n" + "".join(f"{i},{'x' * 50}\n" + (",\n" if i % 7 == 0 else "") for i in range(4000))
    paths = [write(tmp_path, f"f{k}.csv", text) for k in (2, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        source = imports.csv_source(spark, paths)
        assert source.cells.select("file_path", "block").distinct().count() > 8
        imported = imports.import_files(source, start=1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    # Read with other splits than those the ids were counted with.
    got = [(r["__record_id"], r["__source_file"], int(r["n"])) for r in imported.rows.collect()]
    assert sorted(got) == [(k * 4000 + i + 1, name, i) for k, name in enumerate(["f2.csv", "f1.csv"]) for i in range(4000)]


def test_hot_file_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    paths = [write(tmp_path, f"{k}.csv", "a\n" + "v\n" * (50 if k == 3 else 2)) for k in range(6)]
    monkeypatch.setattr("labelflow.session.broadcast_if_small.__defaults__", (2,))
    imported = imports.import_files(imports.csv_source(spark, paths))
    assert [r[0] for r in rows(imported.rows)] == list(range(1, 61))
    assert {r["__source_file"]: r["count"] for r in imported.rows.groupBy("__source_file").count().collect()}["3.csv"] == 50


def test_workbooks(spark, tmp_path):
    first = book(tmp_path, "one.xlsx", [["序号", " 摘要 ", None, "flag"], [1, "a & <b>", "no header", None], [None, None, None, None], [2.5, "", None, "y"]], "A1")
    second = book(tmp_path, "two.xlsx", [["摘要", "序号", "flag"], ["c", 3, "n"]])
    source = imports.workbook_source(spark, [first, second])
    report = imports.preflight(source)
    assert report.reference == ["序号", "摘要", "flag"]
    files = {r["file_name"]: r for r in report.files.collect()}
    assert (files["one.xlsx"]["row_count"], files["one.xlsx"]["records"], files["two.xlsx"]["status"]) == (3, 2, "reordered")
    imported = imports.import_files(source)
    assert rows(imported.rows) == [(1, "one.xlsx", "1", "a & <b>", ""), (2, "one.xlsx", "2.5", "", "y"), (3, "two.xlsx", "3", "c", "n")]


def test_workbook_cell_types(spark, tmp_path):
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="str"><v>d</v></c></row>'
        '<row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="1"><v>45292.5</v></c><c r="D3"><v>1E-3</v></c></row>'
        '<row r="5"><c r="B5" s="2"><v>0.25</v></c><c r="D5" t="e"><v>#N/A</v></c></row>'
    )
    path = tmp_path / "types.xlsx"
    with zipfile.ZipFile(path, "w") as target:
        target.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="x" sheetId="2" r:id="rId7"/><sheet name="y" sheetId="1" r:id="rId1"/></sheets></workbook>')
        target.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="/xl/worksheets/first.xml"/></Relationships>')
        target.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>a</t></r><r><t>1</t></r></si><si><t>when</t><rPh><t>x</t></rPh></si></sst>')
        target.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="165" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        target.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    imported = imports.import_files(imports.workbook_source(spark, [str(path)]))
    assert imported.columns == ["a1", "when", "d"]
    assert rows(imported.rows) == [(1, "types.xlsx", "True", "2024-01-01 12:00:00", "0.001"), (2, "types.xlsx", "", "06:00:00", "#N/A")]


def test_file_hashes_whole_and_in_pieces(spark, tmp_path):
    for name in ("a b.bin", "c%20.bin"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    expected = sorted(hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in ("a b.bin", "c%20.bin"))
    for limit in (1 << 20, 0):
        assert sorted(r["file_hash"] for r in file_hashes(spark, [str(tmp_path)], limit).collect()) == expected


def test_files_keep_the_order_given(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    paths = [write(tmp_path, "z.csv", "a\n"), str(tmp_path / "dir"), write(tmp_path, "b.csv", "a\n")]
    for name in ("y.csv", "x.csv"):
        write(tmp_path / "dir", name, "a\n")
    listed = list_files(spark, paths).orderBy("file_no").collect()
    assert [r["file_path"].rsplit("/", 1)[1] for r in listed] == ["z.csv", "x.csv", "y.csv", "b.csv"]


def test_files_by_suffix(spark, tmp_path):
    paths = [
        write(tmp_path, "a.csv", "x,y\n1,2\n"),
        book(tmp_path, "b.XLSX", [["y", "x"], [4, 3]]),
        write(tmp_path, "c.csv", "x,y\n5,6\n"),
    ]
    imported = imports.import_files(imports.open_source(spark, paths))
    assert rows(imported.rows) == [(1, "a.csv", "1", "2"), (2, "b.XLSX", "3", "4"), (3, "c.csv", "5", "6")]
    assert rows(imports.import_files(imports.open_source(spark, paths[1:2])).rows) == [(1, "b.XLSX", "4", "3")]
    assert imports.import_files(imports.open_source(spark, paths[:1])).rows.count() == 1
    with pytest.raises(ValueError, match="notes.txt"):
        imports.open_source(spark, ["notes.txt"])


def test_no_files(spark):
    source = imports.csv_source(spark, [])
    assert imports.preflight(source).summary().first().asDict() == {"files": 0, "total_rows": 0, "can_import_strict": False}
    assert imports.import_files(source).rows.count() == 0


def test_names_with_glob_characters(spark, tmp_path):
    write(tmp_path, "a[1]{x}?*.csv", "a\n1\n")
    write(tmp_path, "a1.csv", "a\n2\n")
    imported = imports.import_files(imports.csv_source(spark, [str(tmp_path)]))
    assert sorted((r["__source_file"], r["a"]) for r in imported.rows.collect()) == [("a1.csv", "2"), ("a[1]{x}?*.csv", "1")]
    assert imported.ledger.filter("length(file_hash) = 64").count() == 2


def test_schema_table_and_history(spark):
    table = imports.schema_table(spark, ["x", "y"]).orderBy("column_index").collect()
    assert [(r["column_name"], r["column_index"], r["data_type_guess"]) for r in table] == [("x", 1, "text"), ("y", 2, "text")]


def test_all_rejected_files_are_listed(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"f{k:02d}.csv").write_text("x,y\n1,2\n" if k == 0 else "x\n1\n")
    source = imports.csv_source(spark, [str(tmp_path)])
    with pytest.raises(ValueError, match="headers of 24 files do not fit"):
        imports.import_files(source)
    report = imports.preflight(source)
    assert imports.rejected_files(report.files, imports.ImportOptions()).count() == 24


def test_local_files_by_any_spelling(tmp_path):
    from labelflow.sources.files import file_system

    path = tmp_path / "a b.txt"
    path.write_text("x")
    for uri in (str(path), f"file:{path}", f"file://{path}", path.as_uri()):
        system, name = file_system(uri)
        assert system.open_input_stream(name).read() == b"x"
