import json
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelflow.operators import answers, judge, splits
from labelflow.operators.answers import Ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLIES = {
    "fenced": '```json\n{"is_target": true, "core_reason": "rotor blades"}\n```',
    "chatty": 'Sure: {"is_target": "相关", "reason": " 备用 "} ok',
    "number": '{"is_target": 2, "core_reason": ""}',
    "array": '[{"is_target": true}]',
    "broken": "{no json",
    "two": '{"is_target": true}{"is_target": false}',
}


def scorer(texts):
    if "boom" in texts:
        raise RuntimeError("service down")
    return [REPLIES[text] for text in texts]


CONFIG = judge.JudgeConfig(text_column="text", id_column="id")


@pytest.fixture()
def df(spark):
    texts = [*REPLIES, "boom", " 　", None]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start=1)], "id long, text string")


def by_text(rows):
    return {row["text"]: row for row in rows.collect()}


def test_judge(df):
    judged = judge.judge(df, scorer, CONFIG)
    assert judged.columns == ["id", "text", "LLM判定", "LLM理由", "LLM_JSON", "LLM_ERROR"]
    rows = by_text(judged)
    assert (rows["fenced"]["LLM判定"], rows["fenced"]["LLM理由"], rows["fenced"]["LLM_ERROR"]) == (True, "rotor blades", "")
    assert json.loads(rows["fenced"]["LLM_JSON"]) == {"is_target": True, "core_reason": "rotor blades"}
    assert (rows["chatty"]["LLM判定"], rows["chatty"]["LLM理由"]) == (True, "备用")
    assert (rows["number"]["LLM判定"], rows["number"]["LLM理由"]) == (True, "")
    assert rows["array"]["LLM_ERROR"] == "LLM 返回的 JSON 顶层不是对象"
    assert rows["broken"]["LLM_ERROR"] == rows["two"]["LLM_ERROR"] == "JSON 解析失败"
    assert rows["boom"]["LLM_ERROR"] == "service down" and rows["boom"]["LLM判定"] is None
    assert rows[None]["LLM_ERROR"] == rows[" 　"]["LLM_ERROR"] == "文本为空"
    assert {r["text"] for r in judge.judge_failures(judged).collect()} == {"array", "broken", "two", "boom", " 　", None}
    assert {r["text"] for r in judge.promote(judged, "LLM_ERROR").collect()} == {"fenced", "chatty", "number"}
    assert judge.promote(judged).count() == df.count()


@pytest.mark.parametrize("limit, judged_ids", [(0, []), (2, [1, 2]), (100, [1, 2, 3, 4, 5, 6, 7])])
def test_judge_limit_takes_the_first_rows_with_text(df, limit, judged_ids):
    config = judge.JudgeConfig(text_column="text", id_column="id", limit=limit, calls=judge.Calls(at_a_time=2))
    rows = judge.judge(df, scorer, config).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["id"]) if r["LLM_ERROR"] not in (None, "文本为空")] == judged_ids
    assert len(rows) == df.count()


def test_judge_limit_skips_rows_without_text(spark):
    df = spark.createDataFrame([(1, ""), (2, "fenced"), (3, "chatty"), (4, "number")], "id long, text string")
    rows = judge.judge(df, scorer, judge.JudgeConfig(text_column="text", id_column="id", limit=2)).collect()
    assert sorted(r["id"] for r in rows if r["LLM判定"] is not None) == [2, 3]


def fields():
    return judge.normalize_fields([
        {"name": "is_target", "type_label": "布尔", "requirement": "about kites", "example": "true", "required": True},
        {"name": "two words", "type_label": "文本"},
        {"name": "season", "type_label": "枚举", "requirement": "when", "example": "may", "required": False, "enum_options": "may,june"},
        {"name": "season", "type_label": "数字"},
        {"name": "___", "type_label": "文本"},
        {"name": "\t"},
        {"name": "größe_1", "type_label": "?"},
    ])


def test_normalize_fields():
    got = fields()
    assert [f.name for f in got] == ["is_target", "season", "größe_1"]
    assert [f.type for f in got] == ["boolean", "enum", "string"]
    assert got[1].requirement == "when。可选值：may,june" and not got[1].required
    assert got[2].requirement == "按字段说明输出"
    assert judge.normalize_fields(judge.field_rows(got))[0] == got[0]
    assert judge.normalize_fields(judge.field_rows()) == judge.DEFAULT_FIELDS
    assert judge.field_schema(got).simpleString() == "struct<is_target:boolean,season:string,größe_1:string>"


def test_example_values():
    cases = {
        ("boolean", "是"): True, ("boolean", "no"): False, ("number", "0.91"): 0.91, ("integer", "3.7"): 3,
        ("number", "x"): "x", ("integer", "x"): "x", ("string", "s"): "s", ("boolean", ""): True,
        ("number", ""): 0.86, ("integer", ""): 1, ("enum", ""): "示例",
    }
    for (kind, raw), value in cases.items():
        assert judge.example_value(kind, raw) == value


def test_system_prompt():
    spec = judge.normalize_fields([
        {"name": "weight", "type_label": "数字", "requirement": "in grams", "example": "0.25"},
        {"name": "wheels", "type_label": "整数", "requirement": "how many", "example": "4", "required": False},
    ])
    prompt = judge.system_prompt(" 判断文本 ", spec)
    assert '"weight": 0.25' in prompt and '"wheels": 4' in prompt
    assert "- weight (number，必填): in grams\n- wheels (integer，可空): how many" in prompt
    assert json.loads(prompt.rsplit("\n", 1)[1]) == {"weight": 0.25, "wheels": 4}


def test_structured_judge(df):
    spec = fields()[:2]
    rows = by_text(judge.structured_judge(df.filter("id < 8"), scorer, spec, "text", id_column="id"))
    assert rows["fenced"]["is_target"] == "true" and rows["fenced"]["season"] == "" and rows["fenced"]["LLM_ERROR"] == ""
    assert json.loads(rows["fenced"]["LLM_JSON"]) == {"is_target": True, "season": None}
    assert rows["boom"]["is_target"] == rows["boom"]["LLM_JSON"] == "" and rows["boom"]["LLM_ERROR"] == "service down"
    assert judge.structured_judge(df.select("text").limit(1), scorer, spec, "text", calls=judge.Calls(at_a_time=2)).count() == 1
    typed = by_text(judge.structured_judge(df.filter("id < 8"), scorer, spec, "text", id_column="id", typed=True, calls=judge.Calls(texts_per_call=2)))
    assert typed["fenced"]["is_target"] is True and typed["fenced"]["season"] is None


@pytest.mark.parametrize(
    "reply, value",
    [
        ('{"a": 1}', '{"a":1}'),
        ('```\n{"a": 1}\n```', '{"a":1}'),
        ('```JSON {"a": {"b": [1, 2]}} ```', '{"a":{"b":[1,2]}}'),
        ('1 {"a": 1} 2', '{"a":1}'),
        ('"text"', '"text"'),
        ("null", "null"),
        ("", None),
        ("} {", None),
    ],
)
def test_parse_reply(spark, reply, value):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(F.to_json(judge.parse_reply(F.col("r"))).alias("j")).first()["j"] == value


@pytest.mark.parametrize("raw, truth", [("true", True), ("0", False), ("0.5", True), ('" 是 "', True), ('"no"', False), ("null", False), ("[1]", False)])
def test_field_truth(spark, raw, truth):
    df = spark.createDataFrame([(f'{{"k": {raw}}}',)], "r string")
    parsed = judge.parse_reply(F.col("r"))
    assert df.select(judge.field_truth(parsed, "k").alias("t"), judge.field_truth(parsed, "z").alias("z")).first() == (truth, False)


def counting_scorer(path):
    """A scorer that notes each text it is sent in a file of its own."""
    import os
    import uuid

    def score(texts):
        with open(os.path.join(path, uuid.uuid4().hex), "w") as notes:
            notes.write("\n".join(texts))
        if any(text.startswith("down") for text in texts):
            raise RuntimeError("out of order")
        return [ValueError("bad text") if text == "bad" else '{"is_target": true}' for text in texts]

    return score


def sent(path):
    return sorted(line for notes in path.iterdir() for line in notes.read_text().split("\n"))


def test_partitions_stay_and_each_text_is_sent_once(spark, tmp_path):
    df = spark.range(640).selectExpr("id", "concat('t', id) as text").repartition(64)
    judged = judge.judge(df, counting_scorer(str(tmp_path)), CONFIG)
    parts = splits.assign_splits(judged, "LLM判定", id_col="id")
    assert parts.count() == judged.count() == 640
    assert sent(tmp_path) == sorted(f"t{k}" for k in range(640))
    assert len(judged.inputFiles()) == 64


def test_errors_of_single_texts_cost_no_further_call(spark, tmp_path):
    df = spark.createDataFrame([(k, "bad" if k % 3 == 0 else f"t{k}") for k in range(30)], "id long, text string").coalesce(1)
    rows = judge.judge(df, counting_scorer(str(tmp_path)), judge.JudgeConfig(text_column="text", id_column="id", calls=judge.Calls(texts_per_call=5))).collect()
    assert {r["LLM_ERROR"] for r in rows if r["text"] == "bad"} == {"bad text"}
    assert len(list(tmp_path.iterdir())) == 6


def test_an_outage_makes_few_calls(spark, tmp_path):
    df = spark.createDataFrame([(k, f"down{k}") for k in range(500)], "id long, text string").coalesce(1)
    rows = judge.judge(df, counting_scorer(str(tmp_path)), CONFIG).collect()
    assert {r["LLM_ERROR"] for r in rows} == {"out of order"}
    assert len(list(tmp_path.iterdir())) <= 50


def test_a_scorer_that_recovers_is_used_again():
    state = {"calls": 0}

    def flaky(texts):
        state["calls"] += 1
        if state["calls"] <= 6:
            raise RuntimeError("down")
        return ["{}"] * len(texts)

    caller = judge._Caller(flaky, judge.Calls(texts_per_call=2, max_failures=2))
    answers = caller.ask([str(k) for k in range(40)])
    assert answers[0] == (None, "down") and answers[-1] == ("{}", None)
    assert len(answers) == 40


@pytest.mark.parametrize("bad", [range(2), range(5), range(16), range(18), range(100, 150), [*range(16), *range(16, 480, 16)], [*range(16), *range(24, 32)]])
@pytest.mark.parametrize("at_a_time", [1, 3])
def test_every_good_text_of_a_healthy_service_is_answered(bad, at_a_time):
    def refuse(texts):
        for text in texts:
            if int(text) in bad:
                raise ValueError(f"refused {text}")
        return ["{}"] * len(texts)

    for size in (16, 40, 500):
        answers = judge._Caller(refuse, judge.Calls(at_a_time=at_a_time)).ask([str(k) for k in range(size)])
        assert [a == ("{}", None) for a in answers] == [k not in bad for k in range(size)]


def test_texts_left_out_in_an_outage_are_asked_after_it():
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) <= 12:
            raise RuntimeError("down")
        return ["{}"] * len(texts)

    answers = judge._Caller(flaky, judge.Calls()).ask([str(k) for k in range(320)])
    alone = {texts[0] for texts in calls[:12] if len(texts) == 1}
    assert [k for k, a in enumerate(answers) if a != ("{}", None)] == sorted(map(int, alone))


def test_calls_are_paced_and_kept_in_order():
    import time

    begins = []
    caller = judge._Caller(lambda texts: begins.append(time.monotonic()) or [t + "!" for t in texts], judge.Calls(texts_per_call=1, at_a_time=4, seconds_between=0.02))
    assert [a for a, _ in caller.ask(list("abcdef"))] == ["a!", "b!", "c!", "d!", "e!", "f!"]
    assert max(begins) - min(begins) >= 0.09


def test_structured_limit_keeps_the_first_rows(df):
    rows = judge.structured_judge(df, scorer, fields()[:1], "text", id_column="id", limit=3).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3]


@pytest.mark.parametrize("first, reason", [("0", "why"), ("false", "why"), ("null", "why"), ("[]", "why"), ("{}", "why"), ('""', "why"), ('"0"', "0"), ("2", "2"), ('"{}"', "{}")])
def test_reason_falls_back_when_the_first_says_nothing(spark, first, reason):
    df = spark.createDataFrame([(1, f'{{"core_reason": {first}, "reason": "why"}}')], "id long, text string")
    assert judge.judge(df, lambda texts: texts, CONFIG).first()["LLM理由"] == reason


def test_keys_may_hold_a_quote(spark):
    parsed = judge.parse_reply(F.col("r"))
    df = spark.createDataFrame([('{"it\'s": "x", "a.b": "y"}',)], "r string")
    assert df.select(judge.field_text(parsed, "it's"), judge.field_text(parsed, "a.b")).first() == ("x", "y")
    with pytest.raises(ValueError):
        judge.field_text(parsed, "'\"")


# --- ledger and the limit for the whole job -----------------------------------


def ledger_at(path, **options):
    return Ledger(str(path / "ledger"), "rule", "prompt", **options)


def test_a_ledger_answers_each_text_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    config = judge.JudgeConfig(text_column="text", id_column="id", ledger=ledger_at(tmp_path))
    df = spark.range(300).selectExpr("id", "concat('t', id % 100) as text")
    more = df.unionByName(spark.createDataFrame([(1000, None), (1001, " "), (1002, "new"), (1003, "bad")], "id long, text string"))
    assert judge.judge(df, counting_scorer(str(notes)), config).filter("`LLM判定`").count() == 300
    rows = {r["id"]: r for r in judge.judge(more, counting_scorer(str(notes)), config).collect()}
    assert len(rows) == 304 and rows[1002]["LLM判定"] and rows[1003]["LLM_ERROR"] == "bad text"
    assert rows[1000]["LLM_ERROR"] == rows[1001]["LLM_ERROR"] == "文本为空"
    assert sent(notes) == sorted([f"t{k}" for k in range(100)] + ["new", "bad"])
    # A text that failed is asked again; another prompt is another question.
    judge.judge(more, counting_scorer(str(notes)), config).collect()
    assert sent(notes).count("bad") == 2 and len(sent(notes)) == 103
    other = replace(config, ledger=replace(config.ledger, prompt="other"))
    judge.judge(df, counting_scorer(str(notes)), other).collect()
    assert len(sent(notes)) == 203


def test_a_killed_run_keeps_what_its_finished_tasks_got(spark, tmp_path):
    import os

    notes, broken = tmp_path / "notes", tmp_path / "broken"
    notes.mkdir()
    broken.touch()
    count, flag = counting_scorer(str(notes)), str(broken)

    def dying(texts):
        if "t399" in texts and os.path.exists(flag):
            import time

            time.sleep(6)  # the other tasks end first
            os._exit(1)
        return count(texts)

    config = judge.JudgeConfig(text_column="text", id_column="id", ledger=ledger_at(tmp_path, texts_per_task=50))
    df = spark.range(400).selectExpr("id", "concat('t', id) as text")
    with pytest.raises(Exception):
        judge.judge(df, dying, config)
    kept = config.ledger.replies(spark).count()
    assert 200 <= kept < 400
    broken.unlink()
    judged = judge.judge(df, dying, config)
    assert judged.filter("`LLM判定`").count() == 400
    # Only texts of the task that died were sent twice.
    assert len(set(sent(notes))) == 400 and len(sent(notes)) <= 400 + (400 - kept)


def busy_scorer(path):
    """Notes when each call begins and ends."""
    import os
    import time
    import uuid

    def score(texts):
        begin = time.time()
        time.sleep(0.05)
        with open(os.path.join(path, uuid.uuid4().hex), "w") as notes:
            notes.write(f"{begin} {time.time()} {len(texts)}")
        return ['{"is_target": true}'] * len(texts)

    return score


@pytest.mark.parametrize("in_flight, at_a_time", [(1, 4), (3, 1), (6, 2), (5, 2)])
def test_calls_in_flight_are_bounded_for_the_job(spark, tmp_path, in_flight, at_a_time):
    df = spark.range(160).selectExpr("id", "concat('t', id) as text").repartition(16)
    calls = judge.Calls(texts_per_call=4, at_a_time=at_a_time, in_flight=in_flight)
    config = judge.JudgeConfig(text_column="text", id_column="id", calls=calls)
    if in_flight > 1:
        config = replace(config, ledger=ledger_at(tmp_path, texts_per_task=20))
    notes = tmp_path / "notes"
    notes.mkdir()
    assert judge.judge(df, busy_scorer(str(notes)), config).filter("`LLM判定`").count() == 160
    spans = [tuple(map(float, f.read_text().split())) for f in notes.iterdir()]
    assert sum(n for _, _, n in spans) == 160
    most = max(sum(b <= begin < e for b, e, _ in spans) for begin, _, _ in spans)
    assert 1 <= most <= in_flight
    if in_flight >= 3:
        assert most > 1


def test_each_round_reads_its_own_rows(spark):
    pending = spark.range(400).selectExpr("cast(id as string) as __key", "concat('t', id) as text", "cast(id % 40 as int) as slot")
    rounds = list(answers._rounds(pending, 3))
    assert len(rounds) == 14 and all(part.rdd.getNumPartitions() <= 3 for part in rounds)
    files = [set(part.inputFiles()) for part in rounds]
    assert sum(map(len, files)) == len(set().union(*files))
    assert sorted(r["text"] for part in rounds for r in part.collect()) == sorted(f"t{k}" for k in range(400))


def test_a_hot_text_is_sent_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("labelflow.session.MAX_TASK_ROWS", 50)
    monkeypatch.setattr("labelflow.session.join_groups.__defaults__", (3,))
    notes = tmp_path / "notes"
    notes.mkdir()
    df = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    fields_ = fields()[:1]
    judged = judge.structured_judge(df, counting_scorer(str(notes)), fields_, "text", id_column="id", ledger=ledger_at(tmp_path))
    assert judged.filter("is_target = 'true'").count() == 600
    assert sent(notes).count("hot") == 1 and len(sent(notes)) == 401
