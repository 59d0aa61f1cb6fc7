"""The merger tree as a stream: each micro-batch brings a whole snapshot, state is the last snapshot's nodes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.files import make_folder, read_text, write_bytes
from skyloom.functions.shared import materialize, shared_path
from skyloom.operators.mergertree import _number, carried_ids, interval


class StreamTracker:
    """foreachBatch handler over members (timestep, halo_tag, id), whole snapshots in each batch.

    Where the state of each step lies is written to `folder` before the next begins, so a tracker made anew over the same
    folder goes on where the last one ended, and a batch that the engine replays adds nothing. Snapshots of one batch are
    taken in order; one that arrives after a later one cannot enter the tree any more and raises an error.

    nodes and edges hold a DataFrame for each snapshot, written to the shared folder; they equal build_tree's."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 50, cutoff: int = 5):
        self.spark, self.folder, self.threshold, self.cutoff = spark, folder, threshold, cutoff
        self.done: list[dict] = []
        make_folder(folder)
        while (said := read_text(f"{folder}/{len(self.done)}.json")) is not None:
            self.done.append(json.loads(said))

    def _read(self, kind: str) -> list[DataFrame]:
        return [self.spark.read.parquet(d[kind]) for d in self.done if d.get(kind)]

    @property
    def nodes(self) -> list[DataFrame]:
        return self._read("nodes")

    @property
    def edges(self) -> list[DataFrame]:
        return self._read("edges")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch.select("timestep", F.col("halo_tag").alias("tag"), "id").distinct(), "arrived")
        steps = {d["step"]: d["batch"] for d in self.done}
        for step in sorted(r[0] for r in batch.select("timestep").distinct().collect()):
            if step in steps and steps[step] >= batch_id:
                continue  # of a batch that is replayed
            if steps and step <= max(steps):
                raise ValueError(f"snapshot {step} arrived after snapshot {max(steps)}")
            self._step(step, batch_id, batch.filter(F.col("timestep") == step).select("tag", "id"))

    def _step(self, step: int, batch_id: int, after: DataFrame) -> None:
        last = self.done[-1] if self.done else None
        said = {"step": step, "batch": batch_id, "following": last["following"] if last else 0}

        def put(df: DataFrame, kind: str) -> DataFrame:
            said[kind] = shared_path(self.spark, f"stream-{kind}")
            df.write.parquet(said[kind])
            return self.spark.read.schema(df.schema).parquet(said[kind])

        if last is None:
            fresh = after.select("tag").distinct().select("tag", F.lit(False).alias("zombie"), F.lit(0).alias("age"), F.lit(8).alias("event_mask"), F.lit(None).cast("long").alias("source"))
        else:
            state, before = self.spark.read.parquet(last["state"]), self.spark.read.parquet(last["nodes"])
            aged = before.filter(F.col("zombie") & (F.col("age") > self.cutoff)).select("node_id", "tag", "zombie", "age")
            links, fresh = interval(state, after, self.threshold, self.cutoff, aged)
        numbered = put(_number(fresh, said["following"]).withColumn("timestep", F.lit(step)), "nodes")
        own = numbered.filter("NOT zombie").join(after, "tag").select("node_id", "tag", "zombie", "age", "id")
        if last is not None:
            kept = links.join(numbered.filter("NOT zombie").select("tag", F.col("node_id").alias("descendant_id")), "tag").select("node_id", "descendant_id")
            carried = numbered.filter("zombie").select(F.col("source").alias("node_id"), F.col("node_id").alias("descendant_id"))
            put(kept.unionByName(carried), "edges")
            own = own.unionByName(carried_ids(numbered, state, self.cutoff))
        put(own, "state")
        said["following"] += numbered.count()
        write_bytes(f"{self.folder}/{len(self.done)}.json", [json.dumps(said).encode()])
        self.done.append(said)


def track_files(spark: SparkSession, folder: str, checkpoint: str, threshold: int = 50, cutoff: int = 5) -> StreamTracker:
    """Follow a folder of Parquet snapshots, one file a micro-batch, until all that is there has been read. The tracker's
    state lies beside the stream's own checkpoint."""
    tracker = StreamTracker(spark, f"{checkpoint}/tracker", threshold, cutoff)
    stream = spark.readStream.schema("timestep int, halo_tag long, id long").option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(tracker).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return tracker


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their values by type and window, late ones dropped behind the watermark; batch or stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
