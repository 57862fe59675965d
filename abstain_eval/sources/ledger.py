"""A durable record of model calls: an evaluation that starts again asks only what is open.

The ledger is a folder of parquet files that only grows. An entry is one call, keyed by its run, a
digest of what was asked, and the attempt; it holds the reply, the error, or that no reply came.
Calls are asked in waves and every wave is written before the next is asked, so a job that dies
loses one wave. The digest covers the place of a request in its run and its messages: a
request whose wording or cases changed counts as new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.session import cut_lineage

KEY = ["run_id", "request", "attempt"]
REPLY = ["raw_response", "finish_reason", "usage", "provider", "status", "error_name"]
ENTRY = (
    "run_id string, request string, attempt int, job string, asked_at timestamp, round int, mode string, size int, "
    "replied boolean, raw_response string, finish_reason string, usage string, provider string, status int, error_name string"
)


def request_digest() -> Column:
    """What was asked: the request's place in its run and its messages."""
    place = F.struct("run_id", "round", "batch_id", "task", "mode", "messages")
    return F.sha2(F.to_json(place, {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class CallLedger:
    """Entries under ``path``, a folder that driver and executors share.

    A wave holds about ``calls_per_commit`` calls. With ``ask_failed_again`` a new job asks anew
    what failed or stayed without a reply in earlier jobs; without it their ends stand.
    """

    path: str
    calls_per_commit: int = 100_000
    ask_failed_again: bool = False

    def entries(self, spark: SparkSession) -> DataFrame:
        """Every call of every job, as it was written."""
        spark.createDataFrame([], ENTRY).write.mode("append").parquet(self.path)
        return spark.read.schema(ENTRY).parquet(self.path)

    def known(self, spark: SparkSession, job: str) -> DataFrame:
        """The last entry of every call that ``job`` need not ask."""
        found = self.entries(spark)
        if self.ask_failed_again:
            sound = F.col("replied") & F.col("error_name").isNull() & F.coalesce(F.col("status") < 400, F.lit(True))
            found = found.filter(sound | (F.col("job") == job))
        facts = F.struct("replied", *REPLY)
        last = found.groupBy(*KEY).agg(F.max_by(facts, F.struct("asked_at", "job")).alias("last"))
        return last.select(*KEY, "last.*")

    def append(self, asked: DataFrame, calls: DataFrame, job: str) -> None:
        """Write one entry for every request of ``asked``; ``calls`` are the replies that came."""
        replies = calls.select("run_id", "batch_id", *REPLY, F.lit(True).alias("_came"))
        rows = asked.join(replies, ["run_id", "batch_id"], "left").withColumns(
            {"job": F.lit(job), "asked_at": F.current_timestamp(), "replied": F.col("_came").isNotNull()}
        )
        names = [part.split()[0] for part in ENTRY.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.path)

    def calls(self, sent: DataFrame, ask: Callable[[DataFrame], DataFrame], job: str) -> DataFrame:
        """Replies to ``sent``: those on record, and those that ``ask`` gets now, wave by wave."""
        spark = sent.sparkSession
        keyed = sent.withColumn("request", request_digest())
        open_requests = cut_lineage(keyed.join(self.known(spark, job).select(*KEY), KEY, "left_anti"))
        waves = -(-open_requests.count() // self.calls_per_commit)
        for wave in range(waves):
            part = open_requests.filter(F.pmod(F.xxhash64("request"), F.lit(waves)) == wave)
            self.append(part, ask(part.drop("request")), job)
        places = keyed.select(*KEY, "batch_id", "task", "mode")
        return places.join(self.known(spark, job).filter("replied"), KEY).drop("request", "attempt", "replied")
