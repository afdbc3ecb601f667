"""A manifest of attempts as a log of numbered batches, with compaction that keeps each document's last good attempt.

A batch is one folder, ``batch=N``; running a batch again replaces its folder, so a restarted stream adds nothing twice.
``compact`` writes the last good attempts of all batches up to the newest one as ``base=N``, and only then deletes what that holds.
Readers take the newest finished base and the batches after it, so a compaction that dies midway changes no answer.
One job compacts at a time; batches may be appended meanwhile, and their numbers grow.

Rows are (id, status, local_path, at, ...): ``at`` orders the attempts inside a batch, later batches come later. Of equal ``at``
the one with the greatest local_path counts. A null id takes no part in ``last_good``; a null or empty local_path, or a status other than ok
and skipped, is a failure, and failures are dropped by compaction. An empty batch leaves a folder without rows. A log
without batches can't be read, as it has no columns yet: ``last_good`` raises. Other columns, also ones named
``base`` or ``batch``, come along.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievegrid.sources.folders import delete

USABLE = "id IS NOT NULL AND status IN ('ok', 'skipped') AND local_path <> ''"


@dataclass
class ManifestLog:
    spark: SparkSession
    path: str

    def append(self, rows: DataFrame, number: int) -> None:
        """Also what ``foreachBatch`` calls; a batch that a base holds already is left alone."""
        if number > self._parts()[0]:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def append_stream(self, rows: DataFrame, checkpoint: str):
        """Appends all that a stream has now; run again later, it goes on where it stopped."""
        return rows.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def last_good(self) -> DataFrame:
        """The last good attempt of each id, whatever failed after it."""
        return self._last(*self._parts())

    def compact(self) -> int:
        """Number of the newest batch that the base now holds."""
        base, batches = self._parts()
        if not batches:
            return base
        newest = max(batches)
        self._last(base, batches).write.mode("overwrite").parquet(f"{self.path}/base={newest}")
        self._clear(newest)
        return newest

    def _last(self, base: int, batches: list[int]) -> DataFrame:
        read = [(f"batch={n}", n) for n in batches] + ([(f"base={base}", base)] if base >= 0 else [])
        if not read:
            raise ValueError(f"no batch in {self.path}")
        frames = [self.spark.read.parquet(f"{self.path}/{name}").withColumn("_batch", F.lit(n)) for name, n in read]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).where(USABLE)
        latest = W.partitionBy("id").orderBy(F.desc("_batch"), F.desc("at"), F.desc("local_path"))
        return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_batch")

    def _parts(self) -> tuple[int, list[int]]:
        """The newest finished base, -1 if there is none, and the finished batches after it."""
        found = {"base": [-1], "batch": []}
        for name, number in self._folders():
            if self._exists(f"{name}={number}/_SUCCESS"):
                found[name].append(number)
        base = max(found["base"])
        return base, sorted(n for n in found["batch"] if n > base)

    def _clear(self, newest: int) -> None:
        for name, number in self._folders():
            if number < newest or (name, number) == ("batch", newest):
                delete(self.spark, f"{self.path}/{name}={number}")

    def _folders(self) -> list[tuple[str, int]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return [(n.split("=")[0], int(n.split("=")[1])) for n in names if n.split("=")[0] in ("base", "batch")]

    def _exists(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)
