"""Filings and edit logs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits
from ..plans.api import extract


def filings_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """New Parquet files of pages below ``path`` as (doc_id, html)."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.select(F.col("page_id").cast("string").alias("doc_id"), "html")


def extract_stream(filings: DataFrame) -> DataFrame:
    """Clean tables of a stream of filings; row by row, so no state is kept."""
    return extract(filings)


def replay_stream(targets: DataFrame, edit_stream: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Apply each micro-batch of edits to the grids as the batches before left them; the log's order is seq.

    The touched files of a batch go to ``sink``/epoch=N, which a retried batch
    writes anew.  A file's state is its row of the highest epoch, ``targets``
    where it has none.  The counts are of the batch.  Without a ``trigger``
    all that has arrived is applied and the query ends.
    """
    spark = targets.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def apply(batch: DataFrame, epoch: int) -> None:
        names = batch.where("fileName is not null").select("fileName").distinct()
        touched = targets.join(names, "fileName", "left_semi")
        at = hadoop.Path(sink)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            done = spark.read.option("basePath", sink).schema(edits.replay(targets, batch).withColumn("epoch", F.lit(0)).schema).parquet(sink)
            state = F.struct("epoch", *[c for c in targets.columns if c != "fileName"])
            last = done.where(F.col("epoch") < epoch).join(names, "fileName", "left_semi").groupBy("fileName").agg(F.max_by(state, "epoch").alias("s"))
            last = last.select("fileName", *[F.col("s").getField(c).alias(c) for c in targets.columns if c != "fileName"]).select(*targets.columns)
            touched = last.union(touched.join(last, "fileName", "left_anti").select(*targets.columns))
        # Replay leaves many parts; a batch's files are by size.
        edits.replay(touched, batch).hint("rebalance").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return edit_stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
