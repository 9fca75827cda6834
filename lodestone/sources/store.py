"""A store of traces dealt into buckets by request: reads of the last versions shuffle nothing, a look-up opens one bucket."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .traces import SCHEMA, last_versions


@dataclass(frozen=True)
class Store:
    """Traces under a path, appended by put(), in a folder a version; compact() writes the next version and then points at it.

    A store is read with the number of buckets that it was made with. Readers see the version that was
    current as they began; the folders of old versions are left for the owner to clear. There may be many
    readers but one writer at a time. Rows with a null request_id are kept as one request.
    """

    spark: SparkSession
    path: str
    buckets: int = 32

    def version(self) -> int:
        try:
            return self.spark.read.schema("version long").parquet(f"{self.path}/versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        except AnalysisException:  # nothing was written yet
            return 0

    def _table(self, version: int) -> str:
        """The version's folder as a table of this session, which knows its buckets."""
        name = f"traces_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{version}"
        place = f"{self.path}/v{version}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}, seq long) USING parquet CLUSTERED BY (request_id) SORTED BY (request_id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _write(self, rows: DataFrame, version: int) -> None:
        name = self._table(version)
        d = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.table(name).schema])
        d.repartition(self.buckets, "request_id").sortWithinPartitions("request_id").write.insertInto(name)  # a file a bucket

    def put(self, traces: DataFrame, seq: int = 0) -> None:
        """Append traces; of equal request_id and created_at the larger seq is the later version."""
        self._write(traces.withColumn("seq", F.lit(seq)), self.version())

    def rows(self) -> DataFrame:
        """All versions of all traces."""
        return self.spark.table(self._table(self.version()))

    def last(self) -> DataFrame:
        """The last version of each trace; no shuffle, since a bucket holds all versions of its requests."""
        return last_versions(self.rows())

    def get(self, request_id: str) -> DataFrame:
        """The last version of one trace, from one bucket; no row if there is none."""
        return last_versions(self.rows().filter(F.col("request_id") == request_id))

    def compact(self) -> None:
        """Keep only last versions, one file a bucket."""
        now = self.version()
        self._write(last_versions(self.spark.table(self._table(now)), keep_seq=True), now + 1)
        self._point(now + 1)

    def clear(self) -> None:
        self._point(self.version() + 1)

    def _point(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
