"""Feeds as they arrive: every new file is read, checked and appended, once.

An extension: the batch operators run on each micro-batch, by file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import checks
from ..operators.transform import project, quarantine
from ..plans.plan import IngestionPlan
from ..sources import files


def ingest(spark: SparkSession, folder: str, plan: IngestionPlan, out: str, checkpoint: str, names: list[str] | None = None) -> StreamingQuery:
    """Reads what is in `folder` and hasn't been; sound rows, bad rows and findings go to folders under `out`.

    A file is one text. Batches are written under their number, so a batch that is run again replaces itself.
    names: columns of a delimited feed, the contract's sources if not given.
    """
    spec = plan.contract
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).load(folder)
    texts = arrived.select(files.sample_of(F.col("path")).alias("sample"), F.decode("content", files.charset(spec.encoding)).alias("text"))

    def one(batch: DataFrame, number: int) -> None:
        rows, raw = files.records(spark, files.framed_lines(batch, spec, strict=False), spec, names, strict=False)
        whole = project(rows, raw, plan, strict=False).withColumns({"client": F.lit(spec.client), "iteration": F.lit(1)}).persist()
        good, bad = quarantine(whole)
        good.drop("iteration").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        bad.select("client", "sample", "idx", "error").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        checks.check_runtime(whole).unionByName(checks.check_schema(good.withColumn("error", F.lit(None).cast("string")))).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        whole.unpersist()

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def node_counts(spark: SparkSession, path: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and node of an event log that grows; events later than `late` are left out of closed windows."""
    events = files.read_events(spark, path, stream=True).withColumn("at", F.to_timestamp("ts"))
    return events.withWatermark("at", late).groupBy(F.window("at", window), "node").agg(F.count("*").alias("n")).select("window.start", "node", "n")
