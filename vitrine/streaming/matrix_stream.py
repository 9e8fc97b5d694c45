"""The interaction matrix maintained by Structured Streaming.

``readStream`` over the interaction table (a file or a folder of files) ->
the same projection as the batch view -> one stateful aggregate per (user,
product), whose state is the set of distinct codes seen (a handful of small
integers, whatever the number of events) -> update mode, so a micro-batch
emits only the cells that it changed.  ``foreachBatch`` writes them to a
folder named by the batch; a batch that is run again after a failure
overwrites its own folder, so every cell is counted once.  A reader takes,
for each cell, the row of the latest batch; ``compact`` folds the batches
written so far into one.

State note: the interactions carry no event time in the reference model, so
the state holds one entry per cell of the matrix (unbounded by nature; size
it on the cluster's state store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import scratch_path
from vitrine.sources.fixtures import events_interactions
from vitrine.sources.tables import table_path

CELL = "user_id long, product_id string, score long"


def cells(inter: DataFrame) -> DataFrame:
    """(user_id, product_id, score): the sum of the distinct codes of a cell,
    as a set in one aggregate (``sum(DISTINCT)`` has no streaming form)."""
    codes = F.collect_set("interaction_type")
    return (inter.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
            .groupBy("user_id", "product_id").agg(codes.alias("codes"))
            .select("user_id", "product_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("score")))


def run_stream(inter: DataFrame, out_dir: str) -> int:
    """Drain the stream of interactions into ``out_dir``; batches that had data."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/cells/batch={batch_id}")
    q = (cells(inter).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", out_dir + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in q.recentProgress)


def read_matrix(spark: SparkSession, out_dir: str) -> DataFrame:
    """The matrix after all batches so far: each cell's latest row."""
    rows = spark.read.schema(CELL + ", batch long").parquet(f"{out_dir}/cells")
    return rows.groupBy("user_id", "product_id").agg(F.max_by("score", "batch").alias("score"))


def compact(spark: SparkSession, out_dir: str, target: str) -> DataFrame:
    """Write the matrix so far as one table, to serve readers that come often."""
    read_matrix(spark, out_dir).write.parquet(target)
    return spark.read.schema(CELL).parquet(target)


def stream_matrix(spark: SparkSession, sf_dir: str, out_dir: str | None = None,
                  max_files_per_trigger: int = 1) -> DataFrame:
    """Run the stream over the events to completion and return the matrix."""
    path = table_path(sf_dir, "events")
    # as a pattern, since a stream takes a single file by a pattern only
    src = (spark.readStream.schema(spark.read.parquet(path).schema)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]"))
    out_dir = out_dir or scratch_path(spark, "stream-matrix")
    run_stream(events_interactions(src), out_dir)
    return read_matrix(spark, out_dir)
