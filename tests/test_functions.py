import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelflow.functions import labels as lb
from labelflow.functions import text as tx


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row["r"] for row in rows]


def test_strip_removes_what_python_removes(spark):
    edges = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = [f"{c}a{c}b{c}{c}" for c in edges] + ["", "  ", "x", "　无人机\t", "​a​"]
    assert column(spark, values, tx.strip) == [v.strip() for v in values]


def test_to_number_reads_plain_numbers_only(spark):
    values = ["0.5", " 7 ", "1e3", ".5", "5.", "-2", "bad", "", "0.5d", "0x1p-1", "inf", "-Infinity", None, "1 2"]
    got = column(spark, values, tx.to_number)
    assert got == [0.5, 7.0, 1000.0, 0.5, 5.0, -2.0, None, None, None, None, float("inf"), float("-inf"), None, None]
    assert str(column(spark, ["NaN"], tx.to_number)[0]) == "nan"


def test_fold_missing(spark):
    values = ["a", "", None, "  "]
    assert column(spark, values, lambda c: tx.fold_missing(c, "?")) == ["a", "?", "?", "  "]
    assert column(spark, values, lambda c: tx.fold_missing(c, "?", trim=True)) == ["a", "?", "?", "?"]


def test_parse_keywords(spark):
    got = column(spark, ["无人机，eVTOL, 无人机\n\n物流 ,", "", "a\r\nb"], tx.parse_keywords)
    assert got == [["无人机", "eVTOL", "物流"], [], ["a", "b"]]


def test_names_and_ratios(spark):
    assert column(spark, ['a/b\\c:d*e?f"g<h>i|j'], tx.safe_file_name) == ["a_b_c_d_e_f_g_h_i_j"]
    assert column(spark, ["[t]:*?/\\" + "x" * 40, ""], tx.safe_sheet_title) == ["_t______" [:8] + "x" * 23, "sheet1"]
    assert column(spark, ["x" * 40], lambda c: tx.safe_sheet_title(c, 12)) == ["x" * 28 + "_12"]
    ratios = column(spark, ["0.5", "n/a", None, "NaN", "-inf", "1e400"], tx.format_ratio)
    assert ratios == ["0.5000", "-", "-", "nan", "-inf", "inf"]


def test_user_prompt(spark):
    assert column(spark, ["t"], tx.user_prompt) == ["待判定文本：\n<<<开始>>>\nt\n<<<结束>>>\n"]


@pytest.mark.parametrize(
    "kind, values, expected",
    [
        ("string", ["是", "不相关", " TRUE ", "No", "maybe", None], [1, 0, 1, 0, None, None]),
        ("boolean", [True, False, None], [1, 0, None]),
        ("double", [1.0, 1.9, 0.0, 2.0, -1.0], [1, 1, 0, 0, 0]),
        ("int", [1, 0, 7], [1, 0, 0]),
    ],
)
def test_binary_label(spark, kind, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    assert [r["c"] for r in df.select("i", lb.binary_label(df, "v").alias("c")).orderBy("i").collect()] == expected


def test_binary_label_strict_fails_on_unknown_words(spark):
    df = spark.createDataFrame([("maybe",)], "v string")
    with pytest.raises(PySparkException, match="maybe"):
        df.select(lb.binary_label(df, "v", strict=True)).collect()


@pytest.mark.parametrize(
    "kind, values, expected",
    [
        ("string", ["相关", "不相关", "YES", None], [True, False, True, False]),
        ("double", [0.0, -0.5, None], [False, True, False]),
        ("boolean", [True, None], [True, False]),
    ],
)
def test_truth(spark, kind, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    assert [r["c"] for r in df.select("i", lb.truth(df, "v").alias("c")).orderBy("i").collect()] == expected
