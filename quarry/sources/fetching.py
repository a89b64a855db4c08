"""Fetched pages and polled feeds as data sources: a partition for each host, and a stream with offsets."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from quarry.functions.text import domain
from quarry.sources.staging import new_path, ship

PAGES = "url string, status int, html string, attempts int"


def _packed(f: Callable) -> str:
    return base64.b64encode(cloudpickle.dumps(f)).decode()


def _unpacked(text: str) -> Callable:
    return cloudpickle.loads(base64.b64decode(text))


def get(url: str, opener: Callable[[str], tuple[int, str | None]], retries: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None, int]:
    """url, status, html, attempts: status 429 waits ``delay`` times 2 to the number of attempts before, other failures ``delay``."""
    status = 0
    for n in range(1, retries + 1):
        try:
            status, body = opener(url)
        except OSError:
            status, body = 0, None
        if status == 200:
            return url, status, body, n
        if n < retries:
            sleep(delay * 2 ** (n - 1) if status == 429 else delay)
    return url, status, None, retries


#: Partitions of a host that is fetched without a delay.
SPLITS = 16


class _Host(InputPartition):
    """The urls of one host, in a folder of their own; without a delay, those of one of its files."""

    def __init__(self, folder: str) -> None:
        super().__init__(folder)
        self.folder = folder


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.opener = options["path"], options["opener"]
        self.retries, self.delay = int(options.get("retries", "3")), float(options.get("delay", "1"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path)
        if not self.delay:  # nothing keeps tasks from asking one host together
            return [_Host(f.path) for f in files.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and "/host=" in f.path and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_"))]
        return [_Host(f.path) for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory and f.base_name.startswith("host=")]

    def read(self, partition: _Host | None) -> Iterator[tuple]:
        from pyarrow import dataset, fs

        if partition is None:  # no hosts
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        opener, first = _unpacked(self.opener), True
        for batch in dataset.dataset(partition.folder, filesystem=files, format="parquet").to_batches(columns=["url"]):
            for url in batch.column("url").to_pylist():
                if not first:
                    time.sleep(self.delay)  # no other task asks this host
                first = False
                yield get(url, opener, self.retries, self.delay)


class Pages(DataSource):
    """Pages fetched from the hosts under ``path`` (folders host=..., Parquet files of urls), one partition for each host."""

    @classmethod
    def name(cls) -> str:
        return "quarry_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(dict(self.options))


def fetched(urls: DataFrame, opener: Callable[[str], tuple[int, str | None]], retries: int = 3, delay: float = 1.0) -> DataFrame:
    """``PAGES`` of the different urls: a host's are fetched one after the other, ``delay`` seconds apart, whatever the number of tasks.
    With a ``delay`` of 0 a host is several partitions, so that a large one isn't one task.

    ``opener`` gives (status, body) or raises OSError, and must be picklable. The urls are staged
    by host in the shared folder, which must be one that pyarrow reaches. Reading the result
    again fetches again: write it.
    """
    spark = urls.sparkSession
    ship(spark)
    path = new_path(spark, "urls")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    u = urls.where(F.col("url").isNotNull()).select("url").distinct()
    u = u.withColumn("host", F.coalesce(F.nullif(domain(F.col("url")), F.lit("")), F.lit("none")))
    # a stated number, which Spark keeps however small the urls are
    (u.repartition("host") if delay else u.repartition(SPLITS, "url")).write.partitionBy("host").parquet(path)
    spark.dataSource.register(Pages)
    return spark.read.format("quarry_pages").option("path", path).option("opener", _packed(opener)).option("retries", str(retries)).option("delay", str(delay)).load()


class _FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.opener, self.most = _unpacked(options["opener"]), int(options.get("most", "1000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.opener(start["at"], self.most)
        return iter(self._rows(start["at"], rows)), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        # after a failure: the rows of that batch again, no more and no fewer
        return iter(self._rows(start["at"], self.opener(start["at"], end["at"] - start["at"])))

    def commit(self, end: dict) -> None:
        pass

    def _rows(self, at: int, rows: list[dict]) -> list[tuple]:
        return [(at + i, json.dumps(r, sort_keys=True)) for i, r in enumerate(rows)]


class Feed(DataSource):
    """Records of a feed that is polled: (at, record), in order of arrival; ``at`` is the stream's offset."""

    @classmethod
    def name(cls) -> str:
        return "quarry_feed"

    def schema(self) -> str:
        return "at long, record string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _FeedReader(dict(self.options))


def polled(spark: SparkSession, opener: Callable[[int, int], list[dict]], most: int = 1000) -> DataFrame:
    """A stream of a feed's records, at most ``most`` a batch. ``opener(at, n)`` gives up to ``n`` records from place ``at`` on; places don't change."""
    ship(spark)
    spark.dataSource.register(Feed)
    return spark.readStream.format("quarry_feed").option("opener", _packed(opener)).option("most", str(most)).load()
