"""Secrets in every version of every blob, found once per content and rule version.

Blobs are addressed by the SHA-256 of their text.  The ledger is an append-only
table with one row per blob and run: which rule versions ran, and what they found.
A run reads the ledger, scans the blobs that lack some rule version with only the
versions they lack, appends, and joins the findings back to all paths.  DataFrame
functions only.

Positions: the pieces between the matches of a pattern (``split``) and the matches
(``regexp_extract_all``) alternate, so their lengths in code points add up to the
spans.

Defined cases: a null text is empty; equal texts are scanned once, whatever their
number and ids; null and repeated ids keep their rows; an empty table gives no
rows; texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow import session
from labelflow.functions.columns import by_name

LEDGER_SCHEMA = "blob binary, rules array<string>, findings array<struct<start:int,rank:int,stop:int,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if its ``group`` has ``min_chars`` characters."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one class are asked for at their least length: the longest run from the first
# place is the match either way, and a run that is too short counts as no match.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule as ``(start, rank, stop, rule)``; empty where nothing matches."""
    pattern = rule.pattern
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.split(text, pattern, -1).alias("gap"), hits.alias("hit")]
    if rule.group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("part"))
    aligned = F.filter(F.arrays_zip(*parts), lambda x: x["hit"].isNotNull())
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int,rule:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.id).alias("rule"))
        fits = F.length(x["part"] if rule.group else x["hit"]) >= rule.min_chars
        return F.struct(stop.alias("at"), F.when(fits, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    found = F.aggregate(aligned, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``versions`` (``path``, ``text``) with the rule versions they have not met, and append."""
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.id) for r in rules])
    blobs = versions.select("path", blob_id(F.col("text")).alias("blob"))
    firsts = blobs.groupBy("blob").agg(F.min("path").alias("path"))
    done = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    lacking = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    pending = firsts.join(done, "blob", "left").withColumn("pending", lacking).where(F.size("pending") > 0).select(F.col("path").alias("first"), F.col("blob").alias("wanted"), "pending")
    texts = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(pending, F.col("path").eqNullSafe(F.col("first")) & (blob_id(F.col("text")) == F.col("wanted")))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,rule:string>>")
    found = [F.when(F.array_contains("pending", r.id), _spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    scanned = texts.select(F.col("wanted").alias("blob"), F.col("pending").alias("rules"), F.concat(*found).alias("findings"))
    # A row given twice, path and text, is met twice; the ledger has one row per blob.
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings of the given rule versions, in order of start and rule."""
    ids = [r.id for r in rules]
    rank = F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, k)])
    spans = read_ledger(spark, ledger).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(ids))
    span = F.struct(F.col("f.start").alias("start"), rank[F.col("f.rule")].alias("rank"), F.col("f.stop").alias("stop"), F.element_at(F.split("f.rule", "@"), 1).alias("kind"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every path with its blob and the spans of all rules, after bringing the ledger up to date."""
    update_ledger(versions, ledger, rules)
    paths = versions.select("path", blob_id(F.col("text")).alias("blob"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string>>"))
    found = session.materialize(blob_findings(versions.sparkSession, ledger, rules), "findings")
    return paths.join(found, "blob", "left").select("path", "blob", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    kinds = [r.kind for r in base]
    found = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(found, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in kinds]
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select(F.col("path").alias("doc_id"), *counts, F.sha2(spans_text(own), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: str, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one.

    The ledger must have been brought up to date with these texts.
    """
    found, seen = session.measure(blob_findings(docs.sparkSession, ledger, rules), "findings", bytes=F.sum(F.size("spans") * 40 + 32))
    found = found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    text = by_name(text_col)

    def step(state: Column, s: Column) -> Column:
        gap = text.substr(state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = F.array_append(F.array_append(state["out"], gap), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("__spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text))))
    joined = docs.join(session.broadcast_if_small(found, seen), blob_id(text) == F.col("__blob"), "left")
    return joined.select(*[F.when(F.col("__spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else by_name(c) for c in docs.columns])
