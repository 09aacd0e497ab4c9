import pytest

from labelflow.operators import filters, sampling

ROWS = [
    (1, "低空物流无人机", "城市配送"),
    (2, "农用无人机", "植保巡检"),
    (3, "新能源汽车", "电池系统"),
    (4, "eVTOL", "低空载人飞行器"),
    (5, None, "50%_a\\b EVTOL"),
]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "__record_id long, title string, summary string")


def matching(df, columns, words, **modes):
    return sorted(r[0] for r in df.filter(filters.keyword_filter(df, columns, words, **modes)).collect())


BOTH = ["title", "summary"]


def test_any_keyword(df):
    assert matching(df, BOTH, ["无人机", "evtol"]) == [1, 2, 4, 5]
    assert filters.count_matches(df, BOTH, ["无人机", "eVTOL"]).first()["matches"] == 4


def test_all_keywords_over_fields_and_in_one_field(df):
    assert matching(df, BOTH, ["无人机", "配送"], keyword_mode="all") == [1]
    assert matching(df, BOTH, ["无人机", "配送"], keyword_mode="all", field_mode="same_field") == []
    assert matching(df, BOTH, ["无人机", "物流"], keyword_mode="all", field_mode="same_field") == [1]


def test_wildcards_and_literal_keywords(df):
    assert matching(df, BOTH, ["低_人"]) == []
    assert matching(df, BOTH, ["低空_人"]) == [4]
    assert matching(df, BOTH, ["a\\b"]) == [5]
    assert matching(df, BOTH, ["%_A\\"], literal=True) == [5]
    assert matching(df, BOTH, ["城%送"], literal=True) == []
    assert matching(df, ["__record_id"], ["3"]) == [3]


def test_blank_arguments_drop_and_bad_ones_fail(df):
    assert matching(df, [" title ", ""], ["无人机 ", " "]) == [1, 2]
    for columns, words, modes in [
        ([], ["a"], {}),
        (["title"], ["  "], {}),
        (["nope"], ["a"], {}),
        (["title"], ["a"], {"keyword_mode": "some"}),
        (["title"], ["a"], {"field_mode": "some"}),
    ]:
        with pytest.raises(ValueError):
            filters.keyword_filter(df, columns, words, **modes)


def test_filtered_sample(df):
    sample = sampling.filtered_sample(df, BOTH, ["无人机", "eVTOL"], 10, 1)
    assert {r["__sample_source"] for r in sample.collect()} == {"keyword_filter"} and sample.count() == 4
    assert sampling.filtered_sample(df, BOTH, ["无人机"], 1, 1).count() == 1
    with pytest.raises(ValueError):
        sampling.filtered_sample(df, BOTH, ["没有"], 10)


def texts(spark):
    import random

    source = random.Random(5)
    word = lambda: "".join(source.choice("abAB中é%_\\") for _ in range(source.randint(0, 8)))
    return spark.createDataFrame([(k, word() + word(), None if k % 9 == 0 else word()) for k in range(400)], "id long, x string, y string")


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("modes", [("any", "any"), ("all", "any"), ("all", "same_field")])
@pytest.mark.parametrize("words", [["aB", "中", "ba"], ["a", "B"], ["a%中", "b", "%B"], ["a_b", "bb"], ["%", "a"], ["é", "a"], ["A"]])
def test_the_automaton_finds_what_patterns_find(spark, monkeypatch, words, modes, literal):
    df = texts(spark)
    keyword_mode, field_mode = modes
    options = dict(keyword_mode=keyword_mode, field_mode=field_mode, literal=literal)
    by_pattern = {r["id"] for r in df.filter(filters.keyword_filter(df, ["x", "y"], words, **options)).collect()}
    monkeypatch.setattr(filters, "MANY", 1)
    found = df.filter(filters.keyword_filter(df, ["x", "y"], words, **options))
    assert {r["id"] for r in found.collect()} == by_pattern
    one = {r["id"] for r in df.filter(filters.keyword_filter(df, ["x"], words, **options)).collect()}
    monkeypatch.setattr(filters, "MANY", 1000)
    assert one == {r["id"] for r in df.filter(filters.keyword_filter(df, ["x"], words, **options)).collect()}


def test_many_words_make_one_pass(spark):
    df = texts(spark)
    plan = df.filter(filters.keyword_filter(df, ["x", "y"], [f"w{k}" for k in range(500)]))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "LIKE" not in plan.upper().split("PHYSICAL PLAN")[1]


def test_long_texts_of_a_small_file_are_spread_over_tasks(spark):
    from labelflow.plans import queries

    assert queries.keyword_many_all(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 3
