"""Labelling by a pluggable judge.

A judge is a function from a list of texts to a list of reply texts, such as a
client of a chat service.  It is called inside Spark tasks on Arrow batches of
the text column only; prompts, reply parsing, labels and errors are columns.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions.columns import by_name, columns_except
from labelflow.functions.labels import POSITIVE_WORDS
from labelflow.functions.text import none_to_empty, strip
from labelflow.operators import answers
from labelflow.operators.answers import Ledger
from labelflow.operators.ordering import id_at_rank
from labelflow.operators.paging import page
from labelflow.operators.sampling import RECORD_ID
from labelflow.session import materialize, scratch_path

# Texts tried alone at the end of a batch, per ``max_failures``, before the waiting ones are given up.
LAST_TRIES = 4
Scorer = Callable[[list[str]], list[str | Exception]]
# Letters, digits and underscores, with something besides underscores.
LEGAL_NAME = re.compile(r"\w*[^\W_]\w*")

# Error texts, field type names and defaults of the field list.
EMPTY_TEXT = "文本为空"
NOT_AN_OBJECT = "LLM 返回的 JSON 顶层不是对象"
NOT_JSON = "JSON 解析失败"
FIELD_TYPES = {"布尔": "boolean", "文本": "string", "数字": "number", "整数": "integer", "枚举": "enum"}
DEFAULT_REQUIREMENT = "按字段说明输出"
ENUM_PREFIX = "可选值："
TRUE_EXAMPLES = ["true", "1", "yes", "是", "对", "属于"]
DEFAULT_EXAMPLES = {"boolean": True, "number": 0.86, "integer": 1}
TEXT_EXAMPLE = "示例"
# The parts of the system prompt.
PROMPT = """你是文本分类与信息抽取助手。

判定任务：
{task}

输出要求：
- 严格输出 JSON 对象，不要输出 Markdown，不要输出解释文字。
- JSON 只能包含下列一级字段，不允许嵌套对象，不允许数组，不允许增加字段。
- 字段类型必须符合定义。

字段定义：
{fields}

输出 JSON 示例：
{example}"""
FIELD_LINE = "- {name} ({type}，{need}): {requirement}"
REQUIRED, OPTIONAL = "必填", "可空"

SPARK_TYPES = {
    "boolean": T.BooleanType(),
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "string": T.StringType(),
    "enum": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    """One value a judge has to return."""

    name: str
    type: str = "string"
    requirement: str = DEFAULT_REQUIREMENT
    example: str = ""
    required: bool = True
    enum_options: str = ""


# The fields asked for when none are given.
DEFAULT_FIELDS = [
    Field("is_target", "boolean", "判断文本是否属于目标类别", "true"),
    Field("core_reason", "string", "用一句话说明判定理由", "涉及低空物流配送场景"),
    Field("confidence", "number", "输出 0 到 1 之间的置信度", "0.86"),
]


@dataclass(frozen=True)
class Calls:
    """How a scorer is called.

    In one task, ``texts_per_call`` texts go into a call and ``at_a_time`` calls run
    at once, started at least ``seconds_between`` apart.  After ``max_failures`` failed
    texts in a row, each asked alone, the scorer is taken to be out of order.
    With ``in_flight`` no more calls than that run at once in the whole job, and
    ``seconds_between`` holds for the job; speculative tasks would come on top.
    """

    texts_per_call: int = 16
    at_a_time: int = 1
    seconds_between: float = 0.0
    max_failures: int = 3
    in_flight: int | None = None

    def in_one_task(self) -> Calls:
        """The same limits as each of the tasks that send at the same time has to keep them."""
        if self.in_flight is None:
            return self
        if self.in_flight < 1:
            raise ValueError("in_flight must be at least 1")
        at_a_time = min(self.at_a_time, self.in_flight)
        return replace(self, at_a_time=at_a_time, seconds_between=self.seconds_between * answers.lanes(at_a_time, self.in_flight))


@dataclass(frozen=True)
class JudgeConfig:
    text_column: str = "摘要"
    label_column: str = "LLM判定"
    reason_column: str = "LLM理由"
    raw_column: str = "LLM_JSON"
    error_column: str = "LLM_ERROR"
    boolean_key: str = "is_target"
    reason_key: str = "core_reason"
    id_column: str = RECORD_ID
    limit: int | None = None
    calls: Calls = Calls()
    ledger: Ledger | None = None


def normalize_fields(rows: list[dict]) -> list[Field]:
    """Field list from edited rows; blank, repeated and illegal names drop out."""
    def text(row: dict, key: str) -> str:
        return str(row.get(key) or "").strip()

    fields: dict[str, Field] = {}
    for row in rows:
        name = text(row, "name")
        if name in fields or not LEGAL_NAME.fullmatch(name):
            continue
        kind = FIELD_TYPES.get(text(row, "type_label"), "string")
        need, options = text(row, "requirement"), text(row, "enum_options")
        if kind == "enum" and options:
            need = "。".join(filter(None, [need, ENUM_PREFIX + options]))
        fields[name] = Field(
            name, kind, need or DEFAULT_REQUIREMENT, text(row, "example"), bool(row.get("required", True)), options
        )
    return list(fields.values())


def field_rows(fields: list[Field] | None = None) -> list[dict]:
    """The inverse of ``normalize_fields`` for an editor; the default fields if none."""
    labels = {value: label for label, value in FIELD_TYPES.items()}
    return [
        {
            "name": f.name,
            "type_label": labels[f.type],
            "requirement": f.requirement,
            "example": f.example,
            "required": f.required,
            "enum_options": f.enum_options,
        }
        for f in fields or DEFAULT_FIELDS
    ]


def field_schema(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type]) for f in fields])


def example_value(kind: str, example: str = "") -> bool | float | int | str:
    """Typed example of a field; an example that does not fit its type stays text."""
    if not example:
        return DEFAULT_EXAMPLES.get(kind, TEXT_EXAMPLE)
    if kind == "boolean":
        return example.lower() in TRUE_EXAMPLES
    if kind in ("number", "integer"):
        try:
            return float(example) if kind == "number" else int(float(example))
        except ValueError:
            return example
    return example


def system_prompt(task: str, fields: list[Field]) -> str:
    lines = [
        FIELD_LINE.format(name=f.name, type=f.type, need=REQUIRED if f.required else OPTIONAL, requirement=f.requirement)
        for f in fields
    ]
    example = {f.name: example_value(f.type, f.example) for f in fields}
    return PROMPT.format(task=task.strip(), fields="\n".join(lines), example=json.dumps(example, ensure_ascii=False))


def parse_reply(reply: Column) -> Column:
    """Reply text to a variant: the whole text, else its outermost braces.

    Code fences are removed first.  NULL when neither reading is valid JSON.
    """
    text = strip(reply)
    inner = strip(F.regexp_replace(text, "^`+|`+$", ""))
    inner = strip(F.regexp_replace(inner, "^(?i:json)", ""))
    text = F.when(text.startswith("```"), inner).otherwise(text)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(_single_value(text), _single_value(braces))


def _single_value(text: Column) -> Column:
    # The parser ignores what follows a complete value; inside brackets it cannot.
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _path(key: str) -> str:
    """JSON path of a member; a quote inside its name is told apart by the other kind of quote."""
    if "'" in key and '"' in key:
        raise ValueError(f"a key cannot hold both kinds of quotes: {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def field_text(value: Column, key: str) -> Column:
    """A member of a parsed reply as text; NULL when absent."""
    return F.try_variant_get(value, _path(key), "string")


def _filled_text(value: Column, key: str) -> Column:
    """A member as text; NULL when it is absent, empty, zero, false or an empty list or object."""
    text = field_text(value, key)
    kind = F.schema_of_variant(F.try_variant_get(value, _path(key), "variant"))
    number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    zero = number & (F.try_variant_get(value, _path(key), "double") == 0)
    empty = ((kind == "BOOLEAN") & (text == "false")) | (~(kind == "STRING") & text.isin("[]", "{}"))
    return F.when(~(zero | empty), F.nullif(text, F.lit("")))


def field_truth(value: Column, key: str) -> Column:
    """A member of a parsed reply as a boolean that is never NULL."""
    member = F.try_variant_get(value, _path(key), "variant")
    kind = F.schema_of_variant(member)
    number = F.try_variant_get(value, _path(key), "double") != 0
    word = F.lower(strip(field_text(value, key))).isin(POSITIVE_WORDS)
    truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, _path(key), "boolean")).when(kind == "STRING", word)
    truth = truth.when((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), number)
    return F.coalesce(truth, F.lit(False))


class _Caller:
    """Sends texts in small calls from a pool of threads, in order, and keeps each text's own error.

    A scorer may return an exception in place of a reply.  If a whole call
    fails, its texts are asked one by one; after ``max_failures`` texts in a row
    that failed alone only one text of each further call is tried, until one
    succeeds.  The texts left out meanwhile wait for the end of the batch: they are
    asked again as soon as any text gets an answer.  If none of the last tries,
    spread over the waiting texts, gets one either, the waiting texts are not sent
    and have the error of the last try.
    """

    def __init__(self, scorer: Scorer, calls: Calls):
        self.scorer, self.calls = scorer, calls
        self.lock, self.next, self.failures = Lock(), 0.0, 0

    def _wait(self) -> None:
        if self.calls.seconds_between:
            with self.lock:
                now = time.monotonic()
                self.next = max(self.next, now) + self.calls.seconds_between
                pause = self.next - now - self.calls.seconds_between
            time.sleep(max(0.0, pause))

    def _call(self, texts: list[str]) -> tuple[bool, list[str | Exception]]:
        self._wait()
        try:
            replies = list(self.scorer(texts))
            if len(replies) != len(texts):
                raise ValueError(f"{len(replies)} replies to {len(texts)} texts")
        except Exception as error:
            self.failures += len(texts) == 1
            return False, [error] * len(texts)
        self.failures = 0
        return True, replies

    def _chunk(self, texts: list[str]) -> list[str | Exception]:
        if not self._down():
            good, replies = self._call(texts)
            if good or len(texts) == 1:
                return replies
        alone: list[str | Exception] = []
        for text in texts:
            if alone and self._down():
                break
            alone += self._call([text])[1]
        return alone

    def _down(self) -> bool:
        return self.failures >= max(1, self.calls.max_failures)

    def _try(self, texts: list[str], waiting: list[int]) -> dict[int, str | Exception]:
        """Ask a few of the waiting texts alone, until one succeeds."""
        tried: dict[int, str | Exception] = {}
        count = min(len(waiting), LAST_TRIES * max(1, self.calls.max_failures))
        for k in range(count):
            at = waiting[(2 * k + 1) * len(waiting) // (2 * count)]
            good, (tried[at],) = self._call([texts[at]])
            if good:
                break
        return tried

    def ask(self, texts: list[str]) -> list[tuple[str | None, str | None]]:
        size, found, waiting = self.calls.texts_per_call, {}, list(range(len(texts)))
        with ThreadPoolExecutor(self.calls.at_a_time) as pool:
            while waiting:
                chunks = [waiting[k : k + size] for k in range(0, len(waiting), size)]
                for chunk, replies in zip(chunks, pool.map(lambda chunk: self._chunk([texts[k] for k in chunk]), chunks)):
                    found |= zip(chunk, replies)
                waiting = [k for k in waiting if k not in found]
                if waiting and self._down():
                    tried = self._try(texts, waiting)
                    found |= tried
                    waiting = [k for k in waiting if k not in found]
                    if self._down():
                        found |= dict.fromkeys(waiting, list(tried.values())[-1])
                        break
        ordered = [found[k] for k in range(len(texts))]
        return [(None, str(a) or type(a).__name__) if isinstance(a, Exception) else (a, None) for a in ordered]


def ask(scorer: Scorer, text: Column, calls: Calls = Calls()) -> Column:
    """Struct of reply and error for each text; NULL texts are not sent.

    Each task sends its own texts, so the input's partitions stay as they are.
    """
    @F.pandas_udf("reply string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        caller = _Caller(scorer, calls)
        for texts in batches:
            sent = texts.dropna()
            replies = caller.ask(sent.tolist()) if len(sent) else []
            frame = pd.DataFrame(replies, index=sent.index, columns=["reply", "error"], dtype=object)
            yield frame.reindex(texts.index)

    return call.asNondeterministic()(text)


def _chosen(df: DataFrame, clean: Column, id_column: str, limit: int | None) -> Column:
    """Whether a row is sent: it has text and, with a limit, is among the first such rows by id."""
    if limit is None:
        return F.col("__clean") != ""
    if limit <= 0:
        return F.lit(False)
    last = id_at_rank(df.filter(clean != ""), id_column, limit)
    return F.col("__clean") != "" if last is None else (F.col("__clean") != "") & (by_name(id_column) <= last)


def _judged(df: DataFrame, scorer: Scorer, text: Column, calls: Calls, ledger: Ledger | None) -> DataFrame:
    """Add ``__parsed`` and ``__failed`` (error text, empty when the reply is an object).

    Answers are written before anything reads them: each text is sent once,
    however often the result is used.  A limit for the whole job needs tasks of its
    own for the calls, so the answers go through a ledger then, a passing one if none is given.
    """
    asked, one_task = df.withColumn("__text", text), calls.in_one_task()
    if ledger is None and calls.in_flight is not None:
        ledger = Ledger(scratch_path(df.sparkSession, "ledger"), "")
    if ledger is None:
        asked = materialize(asked.withColumn("__answer", ask(scorer, F.col("__text"), one_task)).drop("__text"), "answers")
    else:
        at_once = answers.lanes(one_task.at_a_time, calls.in_flight)
        asked = answers.answered(asked, "__text", ledger, lambda t: ask(scorer, t, one_task), at_once).drop("__text")
    asked = asked.withColumn("__parsed", parse_reply(F.col("__answer.reply")))
    failed = (
        F.when(F.col("__answer.error").isNotNull(), F.col("__answer.error"))
        .when(F.col("__parsed").isNull(), NOT_JSON)
        .when(~is_object(F.col("__parsed")), NOT_AN_OBJECT)
        .otherwise("")
    )
    return asked.withColumn("__failed", failed)


def judge(df: DataFrame, scorer: Scorer, config: JudgeConfig = JudgeConfig()) -> DataFrame:
    """Add a boolean label, a reason, the reply as JSON and an error text.

    Rows with empty text get an error; with ``limit`` only the first rows by id
    that have text are judged and the others pass through with NULLs.  The
    answers are stored when this returns, and for good in a ``ledger``.
    """
    clean = strip(none_to_empty(by_name(config.text_column)))
    # Flags are columns of their own, so that long texts are cleaned once.
    flagged = df.withColumn("__clean", clean).withColumn("__blank", F.col("__clean") == "")
    flagged = flagged.withColumn("__chosen", _chosen(df, clean, config.id_column, config.limit))
    judged = _judged(flagged, scorer, F.when(F.col("__chosen"), F.col("__clean")), config.calls, config.ledger)
    chosen = F.col("__chosen")
    parsed, failed = F.col("__parsed"), F.col("__failed")
    error = F.when(F.col("__blank"), EMPTY_TEXT).when(chosen, failed)
    good = chosen & (failed == "")
    reason = F.coalesce(_filled_text(parsed, config.reason_key), field_text(parsed, "reason"), F.lit(""))
    return judged.select(
        *columns_except(df, config.label_column, config.reason_column, config.raw_column, config.error_column),
        F.when(good, field_truth(parsed, config.boolean_key)).alias(config.label_column),
        F.when(good, strip(reason)).alias(config.reason_column),
        F.when(good, F.to_json(parsed)).alias(config.raw_column),
        error.alias(config.error_column),
    )


def structured_judge(
    df: DataFrame,
    scorer: Scorer,
    fields: list[Field],
    text_column: str,
    json_column: str = "LLM_JSON",
    error_column: str = "LLM_ERROR",
    typed: bool = False,
    id_column: str = RECORD_ID,
    limit: int | None = None,
    calls: Calls = Calls(),
    ledger: Ledger | None = None,
) -> DataFrame:
    """Add one column per declared field, the declared part as JSON and an error.

    With ``limit`` only the first rows by id are sent and kept.  The answers are
    stored when this returns, and for good in a ``ledger``.

    Other members of a reply are dropped.  Columns are text and empty when
    absent, or of the declared type and NULL when absent with ``typed``.
    """
    rows = df if limit is None else page(df, 0, limit, id_column)
    judged = _judged(rows, scorer, strip(none_to_empty(by_name(text_column))), calls, ledger)
    parsed, good = F.col("__parsed"), F.col("__failed") == ""
    columns = []
    for field in fields:
        if typed:
            value = F.try_variant_get(parsed, _path(field.name), SPARK_TYPES[field.type].simpleString())
            columns.append(F.when(good, value).alias(field.name))
        else:
            columns.append(F.coalesce(F.when(good, field_text(parsed, field.name)), F.lit("")).alias(field.name))
    members = [F.try_variant_get(parsed, _path(f.name), "variant").alias(f.name) for f in fields]
    declared = F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
    kept = columns_except(df, *[field.name for field in fields], json_column, error_column)
    return judged.select(
        *kept,
        *columns,
        F.when(good, declared).otherwise("").alias(json_column),
        F.col("__failed").alias(error_column),
    )


def judge_failures(df: DataFrame, error_column: str = "LLM_ERROR") -> DataFrame:
    """The rows whose judgement failed."""
    return df.filter(by_name(error_column) != "")


def promote(df: DataFrame, error_column: str | None = None) -> DataFrame:
    """Labelled rows that pass review: all of them, or those without an error."""
    if error_column is None:
        return df
    return df.filter(none_to_empty(by_name(error_column)) == "")
