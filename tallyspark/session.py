"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

_own_folders: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# Session settings the plans are written for; all can be changed at run time.
SETTINGS = {
    # Amounts are exact only if both engines read times in one zone.
    "spark.sql.session.timeZone": "UTC",
    # Large joined orders are split at run time, also where that costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Row rules make long generated methods, and the JVM compiles none above this size.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the session settings."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tallyspark-")
    return _own_folders[app]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Path of a not yet existing folder for one written table."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def together(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps that do not need each other at one time; an error of one is raised when all have ended."""
    with ThreadPoolExecutor(len(steps)) as pool:
        ended = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for step in ended:
        step.result()


SMALL_BYTES = 8 << 20  # of input, below which plans are made once and not again behind every shuffle
SMALL_PARTITIONS = 4


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The settings as long as the block lasts, then those before it."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plans_for(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Settings for work on so many bytes. Few bytes need no partitions to be split or put together at run time, and the jobs that
    this takes last longer than the work."""
    if size >= SMALL_BYTES:
        return nullcontext()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), SMALL_PARTITIONS)
    return settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)})
