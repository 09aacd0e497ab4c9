"""Queries over files, stage tables, models and incremental jobs.

Each writes files derived from the given tables to a fresh scratch folder and
then runs the operator on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators import classifier, epochs, judge, sampling, splits
from labelflow.plans.fixtures import CSV_FILES, write_csv_in_order, write_workbooks
from labelflow.plans.queries import JUDGE, _documents, _judge_input, _labelled, _rounded, keyword_scorer, table
from labelflow.plans.stages import CSV_OPTIONS, STAGES, StageStore, export_csv, union_records, write_csv
from labelflow.session import materialize, scratch_path
from labelflow.sources import imports
from labelflow.sources.csv_files import ROW_BITS
from labelflow.sources.files import WHOLE_FILE_BYTES, file_hashes
from labelflow.streaming import incremental

ID = "__record_id"


def _order_texts(spark, sf_dir) -> DataFrame:
    """Orders with every value as text, the key zero-padded so that it sorts."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("okey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        price.alias("price"),
    )


def _variant_folders(spark, sf_dir) -> list[str]:
    """Four folders: the reference header, a reordered, a shorter and a longer one."""
    orders, root = _order_texts(spark, sf_dir), scratch_path(spark, "variants")
    status = F.coalesce("status", F.lit(""))
    short = (status == "F") & F.col("priority").eqNullSafe("1-URGENT")
    variants = {
        "a": orders.filter(status == "O").select("okey", "status", "priority"),
        "b": orders.filter(status == "P").select("priority", "okey", "status"),
        "c": orders.filter(short).select("okey", "status"),
        "d": orders.filter(~status.isin("O", "P") & ~short).select("okey", "status", "priority", "price"),
    }
    return [write_csv_in_order(rows, "okey", f"{root}/{name}") for name, rows in variants.items()]


def dense_record_id(spark, sf_dir):
    folder = write_csv_in_order(_order_texts(spark, sf_dir), "okey", scratch_path(spark, "orders"))
    return imports.import_files(imports.csv_source(spark, [folder]), start=101).rows.select(ID, "okey", "priority")


def preflight(spark, sf_dir):
    report = imports.preflight(imports.csv_source(spark, _variant_folders(spark, sf_dir)))
    lists = [F.array_join(name, ",").alias(name) for name in ("headers", "missing_columns", "extra_columns")]
    files = report.files.select("status", "header_hash", *lists, "row_count")
    return files.groupBy("status", "header_hash", "headers", "missing_columns", "extra_columns").agg(F.sum("row_count").alias("rows"))


def preflight_summary(spark, sf_dir):
    folders = _variant_folders(spark, sf_dir)
    strict = imports.preflight(imports.csv_source(spark, folders[:2])).summary()
    every = imports.preflight(imports.csv_source(spark, folders)).summary()
    tagged = [df.select(F.lit(name).alias("name"), "total_rows", "can_import_strict") for name, df in (("two", strict), ("four", every))]
    return tagged[0].unionByName(tagged[1])


def import_reconcile(spark, sf_dir):
    source = imports.csv_source(spark, _variant_folders(spark, sf_dir))
    options = imports.ImportOptions(allow_extra_columns=True, allow_missing_columns=True)
    return imports.import_files(source, options=options).rows.select(ID, "okey", "status", "priority", "price")


def workbook_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    source = imports.workbook_source(spark, [write_workbooks(orders, "o_orderkey", scratch_path(spark, "books"))])
    return imports.import_files(source).rows.select(ID, "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def file_hash(spark, sf_dir):
    """One text file per benchmark item, hashed whole and in pieces."""
    path = scratch_path(spark, "items")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    item = F.regexp_extract("file_path", "item_id=([0-9]+)/", 1).cast("long")
    whole, pieces = (file_hashes(spark, [path], whole_bytes=size).select(item.alias("item_id"), "file_hash") for size in (WHOLE_FILE_BYTES, 0))
    return whole.join(pieces.withColumnRenamed("file_hash", "in_pieces"), "item_id")


def import_lineage(spark, sf_dir):
    """Files with a repeated header: repaired names, and the folder, file type and batch of every row, by way of the ledger."""
    path = scratch_path(spark, "repeated")
    orders = _order_texts(spark, sf_dir)
    line = F.format_string('"%s","%s","%s","%s"', *[F.coalesce(c, F.lit("")) for c in ("okey", "status", "priority", "price")])
    halves = {"open": F.col("status").eqNullSafe("O"), "other": ~F.col("status").eqNullSafe("O")}
    for name, condition in halves.items():
        rows = orders.filter(condition).repartitionByRange(CSV_FILES, "okey").sortWithinPartitions("okey")
        # The first line of every file has the header before it.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)) == 0
        headed = rows.select(line.alias("line"), first.alias("first"))
        headed.select(F.when(F.col("first"), F.concat(F.lit("key,state,state,key\n"), "line")).otherwise(F.col("line")).alias("value")).write.text(f"{path}/{name}")
    imported = imports.import_files(imports.csv_source(spark, [f"{path}/{name}" for name in halves]))
    rows = imported.rows
    first, *others = [c for c in rows.columns if c not in imports.SYSTEM_COLUMNS]
    folder = F.when(F.col("file_path").contains("/open/"), 1).otherwise(2).cast("long")
    batches = imported.ledger.select(F.col("batch_id").alias("__batch_id"), folder.alias("file_no"))
    named = rows.join(batches, "__batch_id").withColumn("headers", F.lit(",".join([first, *others])))
    suffix = F.element_at(F.split("__source_file", r"\."), -1)
    return named.select(ID, "file_no", suffix.alias("suffix"), "headers", *[F.col(c).alias(f"cell_{k}") for k, c in enumerate([first, *others])])


def import_history(spark, sf_dir):
    store = StageStore(spark, scratch_path(spark, "store"))
    folders = _variant_folders(spark, sf_dir)
    options = imports.ImportOptions(allow_extra_columns=True, allow_missing_columns=True)
    for folder in folders:
        store.import_csv([folder], options)
    history = store.import_history(9)
    position = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long")
    return history.select(position.alias("position"), "status", "error_message", "header_hash", (F.length("file_hash") == 64).alias("hashed"))


def _imported_store(spark, sf_dir) -> StageStore:
    """A dataset made of two imports; the second widens it by a column."""
    store, orders = StageStore(spark, scratch_path(spark, "store")), _order_texts(spark, sf_dir)
    options = imports.ImportOptions(allow_extra_columns=True)
    parts = {"first": orders.filter("status <=> 'O'").select("okey", "status", "priority"), "second": orders.filter("not status <=> 'O'")}
    for rows in parts.values():
        store.import_csv([write_csv_in_order(rows, "okey", scratch_path(spark, "import"))], options)
    return store


def import_skips_known(spark, sf_dir):
    """Two deliveries; the second repeats the files of the first under other names."""
    store, orders = StageStore(spark, scratch_path(spark, "store")), _order_texts(spark, sf_dir)
    first, others = orders.filter("status <=> 'O'"), orders.filter("not status <=> 'O'")

    def deliver(rows: DataFrame) -> str:
        """Files of equal bytes whenever the rows are equal."""
        path = scratch_path(spark, "delivery")
        rows.repartition(CSV_FILES, "okey").sortWithinPartitions("okey").write.options(**CSV_OPTIONS).csv(path)
        return path

    store.import_csv([deliver(first)], skip_known=True)
    again = deliver(first)
    store.import_csv([again, deliver(others), again], skip_known=True)
    raw = store.read("raw")
    dense = raw.agg((F.max(ID) == F.count_distinct(ID)).alias("dense"), F.count(F.lit(1)).alias("rows"))
    return raw.select("okey", "status").join(F.broadcast(dense))


def dataset_stats(spark, sf_dir):
    return _imported_store(spark, sf_dir).dataset_stats()


def raw_preview(spark, sf_dir):
    """The second page of the raw records, without the system columns."""
    return _imported_store(spark, sf_dir).preview_raw(limit=50, offset=50)


def schema_published(spark, sf_dir):
    store = _imported_store(spark, sf_dir)
    return store.published_schema().select("column_name", "column_index", "data_type_guess", F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT").alias("stamped"))


def incremental_import(spark, sf_dir):
    """Two deliveries of files; the second has one column more."""
    root = scratch_path(spark, "incremental")
    store, orders = StageStore(spark, f"{root}/store"), _order_texts(spark, sf_dir)
    options = imports.ImportOptions(allow_extra_columns=True)
    first = orders.filter("status <=> 'O'").select("okey", "status", "priority")
    write_csv_in_order(first, "okey", f"{root}/in")
    incremental.incremental_import(store, f"{root}/in", options)
    write_csv_in_order(orders.filter("not status <=> 'O'"), "okey", f"{root}/in", mode="append")
    incremental.incremental_import(store, f"{root}/in", options)
    return store.read("raw").select(ID, "okey", "status", "priority", "price")


def _text_scorer(rows: DataFrame) -> DataFrame:
    """Scores by a function of the text, in Arrow batches of the text column."""
    scored = classifier.score_with(rows, lambda texts: [0.75 if "tion" in text else 0.25 for text in texts], "text")
    return scored.select("doc_id", "lang", F.col(classifier.POSITIVE_PROBABILITY).alias("positive"))


def _deliveries(spark, sf_dir) -> DataFrame:
    """Documents, those of one source delivered twice."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return documents.unionByName(documents.filter("source = 'src1'")).drop("source")


def resume_score(spark, sf_dir):
    """A run over the English documents, then one that takes up the rest."""
    store, documents = StageStore(spark, scratch_path(spark, "store")), _deliveries(spark, sf_dir)
    incremental.resume_scoring(store, documents.filter("lang = 'en'"), _text_scorer, "doc_id")
    incremental.resume_scoring(store, documents, _text_scorer, "doc_id")
    return store.read("predictions")


def incremental_score(spark, sf_dir):
    """Two deliveries that overlap; every document is scored once."""
    root = scratch_path(spark, "incremental")
    store, documents = StageStore(spark, f"{root}/store"), _deliveries(spark, sf_dir)
    for rows in (documents.filter("not lang <=> 'de'"), documents.filter("not lang <=> 'en'")):
        rows.write.mode("append").parquet(f"{root}/in")
        incremental.incremental_scoring(store, f"{root}/in", documents.schema, _text_scorer, "doc_id")
    return store.read("predictions")


def incremental_score_hashed(spark, sf_dir):
    """The same over ids that are hashes, in three deliveries; the last holds nothing new."""
    root = scratch_path(spark, "incremental")
    store, documents = StageStore(spark, f"{root}/store"), _deliveries(spark, sf_dir)
    hashed = documents.withColumn("doc_id", F.md5(F.col("doc_id").cast("string")))
    for rows in (hashed.filter("not lang <=> 'de'"), hashed.filter("not lang <=> 'en'"), hashed.filter("lang <=> 'fr'")):
        rows.write.mode("append").parquet(f"{root}/in")
        incremental.incremental_scoring(store, f"{root}/in", hashed.schema, _text_scorer, "doc_id")
    return store.read("predictions")


def _filled_store(spark, sf_dir) -> StageStore:
    """A dataset taken through every stage."""
    store = StageStore(spark, scratch_path(spark, "store"))
    store.replace("raw", _judge_input(spark, sf_dir))
    store.write_sample(sampling.random_sample(store.read("raw"), 150, 42, "doc_id"))
    store.write_labels(judge.judge(store.read("sampled"), keyword_scorer, JUDGE))
    store.promote("error")
    store.write_splits(splits.assign_splits(store.read("reviewed"), "label", id_col="doc_id"))
    store.append("predictions", store.read("raw").select("doc_id"))
    return store


def stage_counts(spark, sf_dir):
    return _filled_store(spark, sf_dir).counts()


def stage_clear(spark, sf_dir):
    store = _filled_store(spark, sf_dir)
    store.clear_downstream("labeled")
    counts = materialize(store.counts().withColumn("after", F.lit("labeled")), "counts")
    store.clear("derived")
    return counts.unionByName(store.counts().withColumn("after", F.lit("derived"))).select("after", "stage", "rows")


def stage_guards(spark, sf_dir):
    """Which stages and columns a dataset with raw records and a sample has, as its guards see them."""
    store = StageStore(spark, scratch_path(spark, "store"))
    store.replace("raw", _documents(spark, sf_dir))
    store.write_sample(store.read("raw").filter("lang <=> 'en'"))

    def passes(check: Callable[[], object]) -> bool:
        try:
            check()
            return True
        except ValueError:
            return False

    stages = [("stage", name, passes(lambda name=name: store.read(name))) for name in STAGES]
    columns = [("column", name, passes(lambda name=name: store.require_column("raw", name))) for name in ("doc_id", "lang", "text")]
    preview = store.preview("reviewed")
    found = spark.createDataFrame([*stages, *columns], "kind string, name string, present boolean")
    rows = store.read("raw").agg(F.count(F.lit(1)).alias("raw_rows")).withColumn("preview_columns", F.lit(len(preview.columns)).cast("long"))
    return found.join(F.broadcast(rows))


def split_ratios(spark, sf_dir):
    """Ratios that do not add up to one are refused; with the others the rows of every part."""
    labelled = _labelled(spark, sf_dir).filter("quality is not null").select("doc_id", "quality")
    tables = []
    for train, val, test in ((0.8, 0.1, 0.1), (0.5, 0.25, 0.25), (0.8, 0.1, 0.2), (1.1, -0.1, 0.0)):
        ratios = F.lit(f"{train}/{val}/{test}").alias("ratios")
        try:
            parts = splits.assign_splits(labelled, "quality", train, val, test, id_col="doc_id")
        except ValueError:
            refused = labelled.agg(F.count(F.lit(1)).alias("rows"))
            tables.append(refused.select(ratios, F.lit("refused").alias("split"), "rows"))
            continue
        tables.append(parts.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(ratios, "split", "rows"))
    return reduce(DataFrame.unionByName, tables)


def stage_replace(spark, sf_dir):
    store = StageStore(spark, scratch_path(spark, "store"))
    documents = _labelled(spark, sf_dir).select("doc_id", "lang", "quality")
    store.replace("labeled", documents.filter("lang = 'en'"), stringify=True)
    store.replace("labeled", documents, stringify=True)
    return store.read("labeled")


def stage_append(spark, sf_dir):
    store, documents = StageStore(spark, scratch_path(spark, "store")), _documents(spark, sf_dir)
    for lang in ("en", "fr", "de", "es"):
        store.append("predictions", documents.filter(F.col("lang") == lang))
    store.append("predictions", documents.filter("lang is null or lang not in ('en', 'fr', 'de', 'es')"))
    return store.read("predictions")


def stage_union(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return union_records(_documents(spark, sf_dir).select("doc_id", "lang"), labels)


def export_chunks(spark, sf_dir):
    """Sheets of a hundred documents in the order of their ids, each with its number and its first id."""
    path = scratch_path(spark, "export")
    export_csv(_labelled(spark, sf_dir).select("doc_id", "lang", "quality"), path, sheet_rows=101, id_col="doc_id")
    back = spark.read.schema("doc_id long, lang string, quality string, sheet long").csv(path, header=True)
    sheets = back.groupBy("sheet", "_metadata.file_path").agg(F.min("doc_id").alias("first_id")).select("sheet", "first_id")
    cells = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("quality", F.lit(""))))
    return back.select("sheet", "doc_id", cells.alias("cells_md5")).join(sheets, "sheet")


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), path)
    rows = imports.import_files(imports.csv_source(spark, [path])).rows
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.md5("text").alias("text_md5"))


# --- classifier -------------------------------------------------------------

TRAIN = classifier.TrainConfig(text_column="text", label_column="quality", id_column="doc_id")


def _planted(rows: DataFrame, count: int = 300) -> DataFrame:
    """Words in every text that tell its quality, so that a classifier that learns makes no error."""
    word = F.when(F.col("quality") == 1, "zzgood").otherwise("zzbad")
    words = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.concat(word, k.cast("string")))
    return rows.withColumn("text", F.concat("text", F.lit(" "), F.array_join(words, " ")))


def _split_documents(spark, sf_dir, count: int = 300):
    labelled = _labelled(spark, sf_dir).filter("quality is not null")
    return splits.assign_splits(_planted(labelled, count), "quality", id_col="doc_id")


EPOCHS = epochs.EpochConfig(text_column="text", label_column="quality", id_column="doc_id")
FEW_WORDS = 100


def train_evaluate(spark, sf_dir):
    """Training by epochs; a few words tell the quality."""
    result = epochs.train_by_epochs(_split_documents(spark, sf_dir, FEW_WORDS), EPOCHS)
    return _rounded(result.metrics.drop("loss", "log_loss"))


def train_score(spark, sf_dir):
    """Scores of all documents by a model trained on the labelled ones; the others carry the words by their length."""
    result = epochs.train_by_epochs(_split_documents(spark, sf_dir, FEW_WORDS), EPOCHS)
    known = _labelled(spark, sf_dir).withColumn("quality", F.coalesce("quality", (F.col("n_chars") > 1000).cast("int")))
    scored = classifier.score(_planted(known, FEW_WORDS).select("doc_id", "text"), result.model, "text")
    p = F.col(classifier.POSITIVE_PROBABILITY)
    sure = F.abs(F.col(classifier.CONFIDENCE) - F.greatest(p, 1 - p)) < 1e-9
    return scored.select("doc_id", F.col(classifier.LABEL_TEXT).alias("label"), (p > 0.5).alias("positive"), sure.alias("sure"))


def run_record(spark, sf_dir):
    """What the record of a saved training run says, next to the saved metrics."""
    root = scratch_path(spark, "runs")
    result = epochs.train_by_epochs(_split_documents(spark, sf_dir, FEW_WORDS), EPOCHS)
    classifier.save_result(result, f"{root}/first")
    runs = classifier.newest_runs(spark, root)
    record = F.from_json("record", "config struct<text_column string, label_column string, epochs long>, candidates array<array<double>>")
    stamped = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT").alias("stamped")
    named = runs.select("run", stamped, record.alias("r")).select("run", "stamped", "r.config.*", F.size("r.candidates").cast("long").alias("tried"))
    metrics = spark.read.parquet(f"{root}/first/metrics").select("split", "support", "tp", "tn")
    return metrics.join(F.broadcast(named))


def score_with_function(spark, sf_dir):
    """Scores by a given function of the text in place of a trained model."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score_with(documents, lambda texts: [0.75 if "tion" in text else 0.25 for text in texts], "text")
    return scored.select(
        "doc_id",
        F.col(classifier.LABEL_TEXT).alias("label"),
        F.col(classifier.POSITIVE_PROBABILITY).alias("positive"),
        F.col(classifier.CONFIDENCE).alias("confidence"),
    )


def reevaluate(spark, sf_dir):
    """A saved model on the current splits: supports and confusion counts."""
    path = scratch_path(spark, "model")
    rows = _split_documents(spark, sf_dir)
    classifier.save_result(classifier.train_classifier(rows, TRAIN), path)
    metrics = classifier.reevaluate(rows, path, TRAIN)
    return metrics.select("split", "support", "tp", "tn", "fp", "fn", F.round("accuracy", 6).alias("accuracy"))
