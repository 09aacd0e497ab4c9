"""Names of the runnable queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators import sampling
from labelflow.plans import file_queries as f
from labelflow.plans import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = q.table(spark, sf_dir, "orders")
    sample = sampling.stratified_sample(orders, "o_orderpriority", 300, 42, "o_orderkey")
    return sample.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows")).orderBy("o_orderpriority")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        q.random_sample,
        q.random_sample_input_order,
        q.strata_sizes,
        q.strata_allocation,
        q.strata_allocation_small_groups,
        q.stratified_sample,
        q.stratified_sample_missing,
        q.keyword_any,
        q.keyword_all_same_field,
        q.keyword_all_any_field,
        q.keyword_many,
        q.keyword_many_all,
        q.keyword_count,
        q.filtered_sample,
        q.keyword_list_parse,
        q.split_floor,
        q.split_floor_labels,
        q.split_floor_sizes,
        q.split_largest_remainder,
        q.split_largest_remainder_small_labels,
        q.label_distribution,
        q.label_distribution_trimmed,
        q.missing_labels,
        q.low_confidence,
        q.quality_summary,
        q.cohen_kappa,
        q.cohen_kappa_missing,
        q.table_count,
        q.next_record_id,
        q.normalize_binary,
        q.normalize_bool,
        q.training_samples,
        q.binary_metrics,
        q.metrics_by_split,
        q.metric_support,
        q.assessment,
        q.misclassified,
        q.prediction_distribution,
        q.judge_rule,
        q.judge_errors,
        q.judge_resumed,
        q.judge_cap,
        q.judge_structured,
        q.judge_structured_cap,
        q.review_promote,
        q.json_extract,
        q.prompt_column,
        q.safe_names,
        q.format_ratio,
        q.page_of_rows,
        q.page_hashed_ids,
        q.page_text_ids,
        q.head_rows,
        q.newest_events,
        f.dense_record_id,
        f.preflight,
        f.preflight_summary,
        f.import_reconcile,
        f.workbook_scan,
        f.file_hash,
        f.import_history,
        f.import_lineage,
        f.import_skips_known,
        f.dataset_stats,
        f.raw_preview,
        f.schema_published,
        f.incremental_import,
        f.resume_score,
        f.incremental_score,
        f.incremental_score_hashed,
        f.stage_counts,
        f.stage_clear,
        f.stage_guards,
        f.split_ratios,
        f.stage_replace,
        f.stage_append,
        f.stage_union,
        f.export_chunks,
        f.csv_round_trip,
        f.train_evaluate,
        f.train_score,
        f.score_with_function,
        f.reevaluate,
        f.run_record,
    ]
    return {function.__name__: function for function in functions}
