"""A catalogue of recorded responses as a Python data source (replay mode), and the response table.

``register(spark)`` and then ``spark.read.format("catalogue").option("path", folder)``.
Each page of a query is an input partition.  A body the validator refuses becomes a
row with ``error``, never an exception; a missing recording fails the read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "key string, page int, body string, via string, seconds double, error string"
#: Filters a catalogue may be asked with; any other stays with the engine.
PUSHED = ("key", "page")


def request_key(url: str, params: dict | None = None) -> str:
    """The identity of a request: its address and sorted parameters."""
    query = "&".join(f"{k}={v}" for k, v in sorted((params or {}).items()))
    return hashlib.sha256(f"{url}?{query}".encode()).hexdigest()[:32]


def refused(body: str) -> str | None:
    """Why a body that came with a success status is a failure."""
    try:
        data = json.loads(body)
    except ValueError:
        return "not JSON"
    if not isinstance(data, dict):
        return "not an object"
    if "error" in data:
        e = data["error"]
        return str(e.get("msg") or e.get("info") or e.get("code") or e) if isinstance(e, dict) else str(e)
    return None


class Page(InputPartition):
    def __init__(self, path: str, key: str, page: int):
        self.path, self.key, self.page = path, key, page


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.cap = options["path"], int(options.get("pages", "60"))
        self.only: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        with open(os.path.join(self.path, "manifest.json"), encoding="utf-8") as f:
            pages = json.load(f)["pages"]
        wanted = [(k, p) for k, n in sorted(pages.items()) for p in range(1, min(n, self.cap) + 1)]
        keep = lambda k, p: self.only.get("key", k) == k and self.only.get("page", p) == p
        return [Page(self.path, k, p) for k, p in wanted if keep(k, p)]

    def read(self, partition: Page) -> Iterator[tuple]:
        with gzip.open(os.path.join(partition.path, f"{partition.key}-{partition.page}.json.gz"), "rt", encoding="utf-8") as f:
            body = f.read()
        yield partition.key, partition.page, body, "recorded", 0.0, refused(body)


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)


def fresh(responses: DataFrame, requests: DataFrame, now: int, ttl: int = 86_400) -> tuple[DataFrame, DataFrame]:
    """(usable responses, requests to fetch): a response is usable if it is valid and younger than ``ttl``."""
    good = responses.where(F.col("error").isNull() & (F.col("fetched_at") > now - ttl))
    newest = good.groupBy("key").agg(F.max_by("body", "fetched_at").alias("body"))
    return requests.join(newest, "key"), requests.join(newest, "key", "left_anti")


def source_of(host) -> F.Column:
    """The source that a host belongs to."""
    return (
        F.when(host.endswith(".sbn.it"), "SBN").when(host.endswith("openlibrary.org"), "Open Library")
        .when(host.endswith(".wikipedia.org") | host.endswith(".wikidata.org"), "Wikidata").otherwise(host)
    )
