"""Runnable queries over the driver tables, one or more per operator."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions import labels as lb
from labelflow.functions import text as tx
from labelflow.operators import classifier, filters, judge, metrics, quality, sampling, splits
from labelflow.operators.answers import Ledger
from labelflow.operators.paging import head, page
from labelflow.session import materialize, scratch_path

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _labelled(spark, sf_dir):
    """Documents with their labels; unlabelled documents have NULLs."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left")


# --- sampling ---------------------------------------------------------------


def random_sample(spark, sf_dir):
    return sampling.random_sample(_orders(spark, sf_dir), 500, 42, "o_orderkey")


def random_sample_input_order(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sampling.random_sample(customers, 200, 7, "c_custkey", allow_zero=True).orderBy("c_custkey")


def strata_sizes(spark, sf_dir):
    return sampling.strata_sizes(_sparse_source(spark, sf_dir), "source").withColumnRenamed("__stratum", "stratum")


def strata_allocation(spark, sf_dir):
    sizes = sampling.strata_sizes(_orders(spark, sf_dir), "o_orderpriority")
    return sampling.proportional_allocation(sizes, 1001).withColumnRenamed("__stratum", "stratum")


def strata_allocation_small_groups(spark, sf_dir):
    documents = _documents(spark, sf_dir).withColumn("cell", F.concat_ws("/", "lang", "source"))
    sizes = sampling.strata_sizes(documents, "cell")
    return sampling.proportional_allocation(sizes, 90).withColumnRenamed("__stratum", "stratum")


def _sparse_source(spark, sf_dir):
    """Documents whose source is empty or NULL for two of the sources."""
    source = F.when(F.col("source") == "src0", "").when(F.col("source") != "src1", F.col("source"))
    return _documents(spark, sf_dir).withColumn("source", source)


def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(_documents(spark, sf_dir), "lang", 150, 42, "doc_id")


def stratified_sample_missing(spark, sf_dir):
    sparse = _sparse_source(spark, sf_dir)
    return sampling.stratified_sample(sparse, "source", 120, 3, "doc_id").drop("source")


# --- filters ----------------------------------------------------------------

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type"]


def _keyword_rows(spark, sf_dir, keywords, **modes):
    parts = table(spark, sf_dir, "part").select(*PART_COLUMNS)
    return parts.filter(filters.keyword_filter(parts, ["p_name", "p_type"], keywords, **modes))


def keyword_any(spark, sf_dir):
    return _keyword_rows(spark, sf_dir, ["WIDGET", "econ%my"])


def keyword_all_same_field(spark, sf_dir):
    return _keyword_rows(spark, sf_dir, ["red", "Widget"], keyword_mode="all", field_mode="same_field")


def keyword_all_any_field(spark, sf_dir):
    return _keyword_rows(spark, sf_dir, ["small", "economy"], keyword_mode="all")


MANY_WORDS = [str(1000 + 7 * k) for k in range(1000)]


def keyword_many(spark, sf_dir):
    """A thousand keywords over two columns."""
    customers = table(spark, sf_dir, "customer").withColumn("balance", F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    wanted = filters.keyword_filter(customers, ["c_name", "balance"], MANY_WORDS, literal=True)
    return customers.filter(wanted).select("c_custkey", "c_name")


ALL_WORDS = [f"k{k:03d}" for k in range(1000)]
# About 5 kB each.
LONG_TEXTS_PER_TASK = 5_000


def keyword_many_all(spark, sf_dir):
    """A thousand keywords that all have to occur, spread over two columns; every third customer lacks one of them."""
    words = F.lit("".join(f"{word.upper()} " for word in ALL_WORDS))
    lacking = F.concat(F.lit("K"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" "))
    held = F.when(F.col("c_custkey") % 3 == 0, F.replace(words, lacking, F.lit(""))).otherwise(words)
    # Five characters a word, the last of which is the gap after it.
    cut = ((F.col("c_custkey") % 900 + 1) * 5).cast("int")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # The texts are a hundred times the size of the file: they are made in tasks of their own.
    customers = customers.repartition(max(1, -(-customers.count() // LONG_TEXTS_PER_TASK)))
    first = F.substring(held, F.lit(1), cut - 1)
    second = F.replace(F.substring(held, cut + 1, F.length(held) - cut - 1), F.lit(" "), F.lit("-"))
    customers = customers.select("c_custkey", "c_name", first.alias("first"), second.alias("second"))
    wanted = filters.keyword_filter(customers, ["first", "second"], ALL_WORDS, keyword_mode="all")
    return customers.filter(wanted).select("c_custkey", "c_name")


def keyword_count(spark, sf_dir):
    found = None
    for name in ("documents", "conversations"):
        rows = table(spark, sf_dir, name).select("text")
        count = filters.count_matches(rows, ["text"], ["and", "the"], keyword_mode="all")
        count = count.select(F.lit(name).alias("name"), "matches")
        found = count if found is None else found.unionByName(count)
    return found


def filtered_sample(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(*PART_COLUMNS)
    return sampling.filtered_sample(parts, ["p_name", "p_type"], ["widget", "ring"], 100, 5, "p_partkey")


def keyword_list_parse(spark, sf_dir):
    raw = F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("，　"), F.col("p_brand"), F.lit(",\n"), F.col("p_name"))
    words = tx.parse_keywords(raw)
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.array_join(words, "|").alias("keywords"), F.size(words).cast("long").alias("n"))


# --- splits -----------------------------------------------------------------


def split_floor(spark, sf_dir):
    rows = splits.assign_splits(_orders(spark, sf_dir), "o_orderstatus", id_col="o_orderkey")
    return rows.select("o_orderkey", "o_orderstatus", "split")


def split_floor_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return splits.assign_splits(rows, "quality", 0.7, 0.1, 0.2, 1, "doc_id")


def split_floor_sizes(spark, sf_dir):
    rows = splits.assign_splits(_sparse_source(spark, sf_dir), "source", 0.7, 0.1, 0.2, id_col="doc_id")
    return splits.split_sizes(rows)


def split_largest_remainder(spark, sf_dir):
    rows = splits.assign_splits(_orders(spark, sf_dir), "o_orderstatus", id_col="o_orderkey", rule="largest_remainder")
    return rows.select("o_orderkey", "o_orderstatus", "split")


def split_largest_remainder_small_labels(spark, sf_dir):
    documents = _documents(spark, sf_dir).withColumn("cell", F.concat_ws("/", "lang", "source"))
    rows = splits.assign_splits(documents, "cell", 0.8, 0.15, 0.05, 9, "doc_id", rule="largest_remainder")
    return rows.select("doc_id", "cell", "split")


# --- label quality ----------------------------------------------------------


def label_distribution(spark, sf_dir):
    return quality.label_distribution(_sparse_source(spark, sf_dir), "source")


def label_distribution_trimmed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    padded = F.when(F.col("event_type") == "error", F.lit("　\t")).otherwise(
        F.concat(F.lit(" 　"), F.col("event_type"), F.lit(" \n"))
    )
    shown = F.when(F.col("value") < 50, padded).otherwise(F.col("event_type"))
    return quality.label_distribution(events.withColumn("label", shown), "label", trim=True)


def missing_labels(spark, sf_dir):
    rows = quality.missing_label_rows(_labelled(spark, sf_dir), "quality")
    return rows.select("doc_id", "lang", "source")


def _confidence_events(spark, sf_dir):
    """Events with a confidence as text, unreadable for some event types."""
    share = F.round(F.col("value") / 500, 4).cast("decimal(10,4)").cast("string")
    text = (
        F.when(F.col("event_type") == "error", "bad")
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), share, F.lit("\n")))
        .when(F.col("event_type") == "signup", F.concat(share, F.lit("d")))
        .otherwise(share)
    )
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return events.select("event_id", kind.alias("label"), text.alias("confidence"))


def low_confidence(spark, sf_dir):
    return quality.low_confidence_rows(_confidence_events(spark, sf_dir), "confidence", 0.7)


def quality_summary(spark, sf_dir):
    return quality.quality_summary(_confidence_events(spark, sf_dir), "label", "confidence", 0.7)


def cohen_kappa(spark, sf_dir):
    kappa = quality.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")
    return kappa.select("pairs", F.round("kappa", 6).alias("kappa"))


def cohen_kappa_missing(spark, sf_dir):
    first = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    rows = _labelled(spark, sf_dir).select(first.alias("rule"), "quality")
    kappa = quality.cohen_kappa(rows, "rule", "quality")
    return kappa.select("pairs", F.round("kappa", 6).alias("kappa"))


def table_count(spark, sf_dir):
    return quality.row_count(table(spark, sf_dir, "lineitem"))


def next_record_id(spark, sf_dir):
    return quality.next_record_id(table(spark, sf_dir, "orders"), "o_orderkey")


# --- label values -----------------------------------------------------------


def _label_words(spark, sf_dir):
    """Conversation turns with a label word in several spellings."""
    word = (
        F.when((F.col("role") == "user") & (F.col("turn") == 0), " Yes　")
        .when(F.col("role") == "user", "相关")
        .when((F.col("role") == "assistant") & (F.col("turn") < 3), "不相关")
        .when(F.col("role") == "assistant", "FALSE")
        .otherwise("maybe")
    )
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", word.alias("word"), (F.col("turn") == 1).alias("flag"), (F.col("turn") - 1.5).alias("number"))


def normalize_binary(spark, sf_dir):
    rows = _label_words(spark, sf_dir)
    values = [lb.binary_label(rows, name).cast("long").alias(f"{name}_class") for name in ("word", "flag", "number")]
    return rows.select("conv_id", "turn", *values)


def normalize_bool(spark, sf_dir):
    rows = _label_words(spark, sf_dir)
    values = [lb.truth(rows, name).alias(f"{name}_truth") for name in ("word", "flag", "number")]
    return rows.select("conv_id", "turn", *values)


def training_samples(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("answer", F.when(F.col("quality") == 1, "是").when(F.col("quality") == 0, " NO "))
    samples = classifier.training_samples(rows, "text", "answer", "doc_id")
    return samples.select("index", F.md5("text").alias("text_md5"), F.col("label").cast("long").alias("label"))


# --- metrics ----------------------------------------------------------------


def _ruled(spark, sf_dir):
    """Labelled documents with a rule's prediction of their quality."""
    documents, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    rows = documents.join(labels, "doc_id")
    predicted = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    return rows.select("doc_id", "quality", "toxic", predicted.alias("predicted"))


def _rounded(df):
    return df.select(*[F.round(name, 6).alias(name) if kind == "double" else name for name, kind in df.dtypes])


def binary_metrics(spark, sf_dir):
    return _rounded(metrics.binary_metrics(_ruled(spark, sf_dir), "predicted", "quality"))


def _metrics_by_split(spark, sf_dir):
    rows = splits.assign_splits(_ruled(spark, sf_dir), "quality", id_col="doc_id")
    return metrics.binary_metrics(rows, "predicted", "quality", by="split")


def metrics_by_split(spark, sf_dir):
    return _rounded(_metrics_by_split(spark, sf_dir))


def metric_support(spark, sf_dir):
    stated = F.when(F.col("split") == "val", 0).when(F.col("split") == "train", F.col("support"))
    rows = _metrics_by_split(spark, sf_dir).withColumn("support", stated.cast("string"))
    support = metrics.metric_support(*[F.col(name) for name in ("support", "tp", "tn", "fp", "fn")])
    return rows.select("split", support.alias("support"))


def assessment(spark, sf_dir):
    found = metrics.assessment(_metrics_by_split(spark, sf_dir))
    return _rounded(found.withColumn("findings", F.array_join("findings", ",")))


def misclassified(spark, sf_dir):
    rows = _ruled(spark, sf_dir).withColumn("is_correct", F.col("predicted") == F.col("quality"))
    return metrics.misclassified(rows, "doc_id", 200).select("doc_id", "quality", "predicted")


def prediction_distribution(spark, sf_dir):
    predicted = F.when(F.col("lang") == "de", "").otherwise(lb.class_text((F.col("n_chars") > 1000).cast("int")))
    rows = _documents(spark, sf_dir).withColumn("prediction", predicted)
    return metrics.prediction_distribution(rows, "prediction")


# --- judge ------------------------------------------------------------------


def keyword_scorer(texts: list[str]) -> list[str | Exception]:
    """A judge by rule: fenced, plain, chatty and broken replies; an error for one word."""
    replies = []
    for text in texts:
        if "license" in text:
            replies.append(RuntimeError("refused"))
            continue
        reply = json.dumps({"is_target": "相关" if "tion" in text else "no", "core_reason": f" {len(text)} chars ", "confidence": 0.5, "other": [1]})
        if "ing" in text:
            reply = f"```json\n{reply}\n```"
        elif "ou" in text:
            reply = f"Here it is: {reply} Done."
        elif "en" in text:
            reply = "no answer"
        replies.append(reply)
    return replies


JUDGE = judge.JudgeConfig(text_column="text", label_column="label", reason_column="reason", raw_column="raw", error_column="error", id_column="doc_id")


def _judge_input(spark, sf_dir):
    """Documents; those of one source have blank text."""
    text = F.when(F.col("source") == "src3", "　 \n").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def judge_rule(spark, sf_dir):
    return judge.judge(_judge_input(spark, sf_dir), keyword_scorer, JUDGE).select("doc_id", "label", "reason", "error")


def judge_errors(spark, sf_dir):
    judged = judge.judge(_judge_input(spark, sf_dir), keyword_scorer, JUDGE)
    return judge.judge_failures(judged, "error").groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


def judge_resumed(spark, sf_dir):
    """A run over the documents of one source, then one over all with the same ledger: whose answer came from the first run."""
    ledger = Ledger(scratch_path(spark, "ledger"), "keyword rule", judge.system_prompt("判断文本", FIELDS))
    config = replace(JUDGE, ledger=ledger, calls=judge.Calls(at_a_time=2, in_flight=8))
    rows = _judge_input(spark, sf_dir)
    first = table(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id")
    judge.judge(rows.join(first, "doc_id", "left_semi"), keyword_scorer, config)
    held = materialize(ledger.replies(spark), "held")
    judged = judge.judge(rows, keyword_scorer, config)
    texts = rows.select("doc_id", ledger.key(tx.strip(tx.none_to_empty(F.col("text")))).alias("key"))
    marked = texts.join(held.withColumn("held", F.lit(True)), "key", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("from_first"))
    return judged.select("doc_id", "label", "reason", "error").join(marked, "doc_id")


def judge_cap(spark, sf_dir):
    capped = judge.JudgeConfig(**{**JUDGE.__dict__, "limit": 100})
    return judge.judge(_judge_input(spark, sf_dir), keyword_scorer, capped).select("doc_id", "label", "reason", "error")


FIELDS = judge.normalize_fields([
    {"name": "is_target", "type_label": "布尔", "requirement": "true if the text is wanted", "example": "true"},
    {"name": "core_reason", "type_label": "文本", "requirement": "why, in a few words"},
    {"name": "confidence", "type_label": "数字", "example": "0.91"},
    {"name": "level", "type_label": "枚举", "enum_options": "高,中,低", "required": False},
])


def judge_structured(spark, sf_dir):
    judged = judge.structured_judge(_judge_input(spark, sf_dir), keyword_scorer, FIELDS, "text", "raw", "error", id_column="doc_id")
    return judged.select("doc_id", "is_target", "core_reason", "confidence", "level", "raw", "error")


def judge_structured_cap(spark, sf_dir):
    """Only the first 100 documents by id are sent and kept."""
    rows = _judge_input(spark, sf_dir)
    judged = judge.structured_judge(rows, keyword_scorer, FIELDS, "text", "raw", "error", id_column="doc_id", limit=100)
    return judged.select("doc_id", "is_target", "core_reason", "confidence", "level", "raw", "error")


def review_promote(spark, sf_dir):
    judged = judge.judge(_judge_input(spark, sf_dir), keyword_scorer, JUDGE)
    return judge.promote(judged, "error").select("doc_id", "label")


def json_extract(spark, sf_dir):
    props = F.col("props")
    reply = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("answer: "), props, F.lit(" end")))
        .when(F.col("event_type") == "error", F.concat(F.lit("["), props, F.lit("]")))
        .when(F.col("event_type") == "signup", F.lit("{broken"))
        .otherwise(props)
    )
    parsed = judge.parse_reply(reply)
    events = table(spark, sf_dir, "events").select("event_id", parsed.alias("parsed"))
    return events.select(
        "event_id",
        F.coalesce(judge.is_object(F.col("parsed")), F.lit(False)).alias("is_object"),
        F.try_variant_get("parsed", "$.k", "long").alias("k"),
    )


def prompt_column(spark, sf_dir):
    system = judge.system_prompt("判断文本", FIELDS)
    documents = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit(system), F.lit("\n"), tx.user_prompt(F.col("text")))
    return documents.select("doc_id", F.md5(prompt).alias("prompt_md5"))


# --- names, numbers, pages --------------------------------------------------


def safe_names(spark, sf_dir):
    raw = F.concat(F.col("c_name"), F.lit('/:"'), F.col("c_mktsegment"), F.lit("?[x]*.xlsx"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        tx.safe_file_name(raw).alias("file_name"),
        tx.safe_sheet_title(raw).alias("first_sheet"),
        tx.safe_sheet_title(raw, 12).alias("later_sheet"),
    )


def format_ratio(spark, sf_dir):
    text = F.when(F.col("p_type") == "ECONOMY", "n/a").otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.format_ratio(text).alias("ratio"))


def page_of_rows(spark, sf_dir):
    return page(_orders(spark, sf_dir), 200, 100, "o_orderkey")


def page_text_ids(spark, sf_dir):
    """A page of line items far beyond the first rows, by an id that is text."""
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("item"), "l_quantity")
    return page(items, 10_500, 200, "item")


def head_rows(spark, sf_dir):
    return head(_orders(spark, sf_dir).orderBy("o_orderkey"), 25)


def page_hashed_ids(spark, sf_dir):
    """A deep page by ids that a hash spreads over the whole range of a long."""
    number = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("long")
    orders = _orders(spark, sf_dir).withColumn("hashed", (number - (1 << 59)) * 15)
    return page(orders, 900, 200, "hashed", shallow=0).select("hashed", "o_orderkey")


def newest_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    return events.orderBy(F.desc("at"), F.desc("event_id")).limit(20)
