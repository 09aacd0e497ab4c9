"""Answers that outlive the job that asked for them.

A ledger is a folder of answers by the hash of judge, prompt and text.  A text whose
answer it holds is not sent again, by whatever rows or runs it comes; a text that
several rows hold is sent once.  Each task's answers are committed when that task
ends, so a job that fails, or loses executors, keeps what its finished tasks paid for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.columns import by_name
from labelflow.session import join_groups, materialize, measure, scratch_path

ANSWERS = "key string, reply string, error string, asked_at string"
# Finished tasks' files stay when the job fails.
COMMIT_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


@dataclass(frozen=True)
class Ledger:
    """Answers of one judge (its name and version) to texts under one prompt, stored below ``path``.

    ``texts_per_task`` texts at most, on average, are lost with a task.
    """

    path: str
    judge: str
    prompt: str = ""
    texts_per_task: int = 512

    def key(self, text: Column) -> Column:
        """What an answer is filed under; lengths keep the parts apart."""
        parts = [F.lit(f"{len(self.judge)}:{len(self.prompt)}:{self.judge}{self.prompt}"), text]
        return F.sha2(F.concat(*parts), 256)

    def _rows(self, spark: SparkSession) -> DataFrame:
        """All stored answers; a folder that is not there yet holds none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not system.exists(folder):
            return spark.createDataFrame([], ANSWERS)
        return spark.read.schema(ANSWERS).parquet(self.path)

    def answers(self, spark: SparkSession) -> DataFrame:
        """One answer per key: the last reply, or the last error of a text that never got one."""
        last = F.max(F.struct(F.col("error").isNull().alias("good"), "asked_at", "reply", "error"))
        return self._rows(spark).groupBy("key").agg(last.alias("last")).select("key", "last.reply", "last.error", "last.asked_at")

    def replies(self, spark: SparkSession) -> DataFrame:
        """Keys that need not be asked again."""
        return self._rows(spark).filter(F.col("error").isNull()).select("key").distinct()


def lanes(calls_at_once: int, in_flight: int | None) -> int | None:
    """How many tasks may send at the same time; None without a limit."""
    return None if in_flight is None else max(1, in_flight // max(1, calls_at_once))


def _rounds(pending: DataFrame, at_once: int) -> Iterator[DataFrame]:
    """The rows of ``at_once`` slots at a time, in as many partitions.

    Each slot is written as a folder of its own, so a round reads its own rows only.
    """
    spark, path = pending.sparkSession, scratch_path(pending.sparkSession, "slots")
    pending.repartition("slot").write.options(**COMMIT_TASKS).partitionBy("slot").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slot=*")
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    slots = [status.getPath().toString() for status in system.globStatus(folder)]
    for first in range(0, len(slots), at_once):
        yield spark.read.schema(pending.drop("slot").schema).parquet(*slots[first : first + at_once]).coalesce(at_once)


def answered(rows: DataFrame, text_column: str, ledger: Ledger, ask: Callable[[Column], Column], at_once: int | None) -> DataFrame:
    """``rows`` with ``__answer`` (reply and error) for their text; NULL texts are not sent.

    At most ``at_once`` tasks send at the same time: a round of that many tasks
    follows the other.
    """
    spark, text = rows.sparkSession, by_name(text_column)
    keyed = rows.withColumn("__key", ledger.key(text))
    wanted = keyed.filter(text.isNotNull()).groupBy("__key").agg(F.min(text).alias("text"))
    pending = wanted.join(ledger.replies(spark).withColumnRenamed("key", "__key"), "__key", "left_anti")
    pending, seen = measure(pending, "pending")
    tasks = -(-seen["rows"] // ledger.texts_per_task)
    slot = F.pmod(F.xxhash64("__key"), F.lit(max(1, tasks)))
    if at_once is None or tasks <= at_once:
        rounds = [pending.repartition(tasks, slot)] if tasks else []
    else:
        rounds = _rounds(pending.withColumn("slot", slot), at_once)
    answer = ask(F.col("text"))
    for part in rounds:
        now = datetime.now(timezone.utc).isoformat()
        sent = part.withColumn("answer", answer)
        stored = sent.select(F.col("__key").alias("key"), "answer.reply", "answer.error", F.lit(now).alias("asked_at"))
        stored.write.mode("append").options(**COMMIT_TASKS).parquet(ledger.path)
    counts = keyed.filter("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("__rows"))
    answer = F.struct("reply", "error").alias("__answer")
    known = ledger.answers(spark).withColumnRenamed("key", "__key").join(counts, "__key").select("__key", answer, "__rows")
    size = F.octet_length("__key") + F.coalesce(F.octet_length("__answer.reply"), F.lit(0)) + F.coalesce(F.octet_length("__answer.error"), F.lit(0))
    known, extent = measure(known, "known", bytes=F.sum(size))
    with_text = join_groups(keyed.filter("__key is not null"), known, "__key", extent, "__rows").drop("__rows")
    nothing = F.lit(None).cast(known.schema["__answer"].dataType).alias("__answer")
    without = keyed.filter("__key is null").withColumn("__answer", nothing)
    return materialize(with_text.unionByName(without).drop("__key"), "answers")
