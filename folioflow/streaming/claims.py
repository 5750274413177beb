"""Claims of queued jobs by a stream: each batch claims once, also if it is run again after a failure.

The claim log is a folder with a folder for each batch. A batch first looks for its own: if it is whole, the batch was run before and
nothing is claimed anew. What earlier batches claimed is left out, so workers that share a log never share a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.jobs import claimable


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class ClaimLog:
    """Claims (job_id, worker_id, claimed_at, batch) in a folder."""

    def __init__(self, spark: SparkSession, folder: str, job_type: str = "long"):
        self.spark, self.folder, self.schema = spark, folder, f"job_id {job_type}, worker_id string, claimed_at timestamp, batch long"

    def claims(self) -> DataFrame:
        if not _exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def claim(self, jobs: DataFrame, batch: int, n: int, worker: str) -> bool:
        """Claim the n oldest claimable jobs for a batch; False if the batch has claimed before."""
        place = f"{self.folder}/batch={batch}"
        if _exists(self.spark, f"{place}/_SUCCESS"):
            return False
        now = F.current_timestamp()
        taken = self.claims().where(F.col("batch") != batch).select("job_id")
        mine = claimable(jobs.join(taken, "job_id", "left_anti"), now, n)
        # A batch that broke off left files without a mark: they are written over.
        mine.select("job_id", F.lit(worker).alias("worker_id"), now.alias("claimed_at")).write.mode("overwrite").parquet(place)
        return True


def claiming(stream: DataFrame, jobs: Callable[[], DataFrame], log: ClaimLog, n: int, worker: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Claim n jobs at each batch of a stream that says when to look; every=None goes through what is there and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda _, batch: log.claim(jobs(), batch, n, worker)).start()
