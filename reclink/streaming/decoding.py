"""Mentions as a stream: decoding as they arrive, and learning by the batch.

The reference semantics have no event time; these are the streaming forms of batch decoding and of asynchronous learning.
Micro-batches are processed whole, and checkpoints with the tables kept by batch make each of them count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from reclink.operators import lattice, learn


def decode_stream(mentions: DataFrame, examples_of: Callable[[DataFrame], DataFrame], params: DataFrame, labels: list[str], longest: dict[str, int], path: str, checkpoint: str, use_gen: bool = True, use_disc: bool = False) -> StreamingQuery:
    """Decode each arriving mention with fixed parameters and add (mention_id, score, segments) to the table at ``path``."""
    chain = lattice.Chain.of(params, labels)

    def write(batch: DataFrame, number: int) -> None:
        ready = lattice.scored(examples_of(batch), params, labels, use_gen, use_disc)
        out = lattice.decode(ready, chain, longest, use_gen, use_disc)
        # a batch that is repeated after a failure replaces its own rows
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OnlineLearner:
    """Discriminative steps by the micro-batch: the synchronous form of asynchronous updates.

    With a ``path``, the parameters after each batch are a table there under the batch's number. A new learner goes on from the
    last one, and a batch that comes again after a failure takes its table instead of counting twice.
    """

    def __init__(self, setting: learn.Setting, params: DataFrame, use_gen: bool = False, path: str | None = None):
        self.setting, self.params, self.use_gen, self.updates, self.objective, self.path = setting, params, use_gen, 0, [], path
        done = self._done()
        if done:
            self._load(max(done))

    def _files(self, path: str):
        spark = self.params.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _done(self) -> list[int]:
        """Numbers of the batches whose tables are complete."""
        if self.path is None:
            return []
        files, where = self._files(self.path)
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
        return [int(n.removeprefix("after-")) for n in names if n.startswith("after-") and files.exists(self._files(f"{self.path}/{n}/_SUCCESS")[1])]

    def _load(self, number: int) -> None:
        rows = self.params.sparkSession.read.parquet(f"{self.path}/after-{number}")
        state = rows.select("updates", "objective").limit(1).first()
        self.params = rows.select(*learn.KEYS, "value")
        if state:
            self.updates, self.objective = state["updates"], list(state["objective"])

    def step(self, examples: DataFrame, number: int | None = None) -> None:
        if number is not None and number in self._done():
            return self._load(number)
        counts = learn.Counts(self.setting, self.params)
        counts.learn_records(examples.where("is_record"), self.use_gen, True)
        if self.setting.options.seg_text_weight > 0:
            counts.learn_texts(examples.where("not is_record"), self.use_gen, True, weight=self.setting.options.seg_text_weight)
        params = learn.added(self.params, counts.table(), self.setting.options.step_size(self.updates))
        self.objective = [*self.objective, counts.log_z]
        self.updates += 1
        if self.path is None or number is None:
            self.params = learn.written(params, "params")
            return None
        state = {"updates": F.lit(self.updates), "objective": F.array(*map(F.lit, self.objective))}
        params.withColumns(state).write.mode("overwrite").parquet(f"{self.path}/after-{number}")
        return self._load(number)

    def run(self, examples: DataFrame, checkpoint: str) -> StreamingQuery:
        return examples.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(rows: DataFrame, time_col: str, late: str, window: str, keys: list[str]) -> DataFrame:
    """Counts of arriving rows by window and keys, with a watermark for late ones."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, window), *keys).agg(F.count(F.lit(1)).alias("n"))
