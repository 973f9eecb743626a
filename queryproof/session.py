"""Session, tables and shared scratch space."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "queryproof") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where driver and executors are one process (a local master, as in tests) a temporary folder serves
    without the setting; it goes when the process ends. On a cluster its absence is an error: executors
    would write to their own disks, and what is read back would be incomplete. So it is where the master
    can't be read, as from a client of Spark Connect.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/queryproof/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="queryproof-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    @cached_property
    def region(self) -> DataFrame:
        return self.read("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.read("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.read("pages")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")
