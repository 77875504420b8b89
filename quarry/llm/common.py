"""What the operators of this subpackage share: tables, the shared folder, and sending the package to the workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: So that workers, which live on from stage to stage, give freed memory back: one arena, no growing thresholds, Arrow on the same heap.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: For work on many arrays of some MB, whose pages cost more than what they hold.
ROOMY = LEAN | {"MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)}


def ship(spark: SparkSession, memory: dict[str, str] = LEAN) -> None:
    """Lets Python workers import this package from where the driver has it (same path, or --py-files on a cluster), and sets how they keep memory."""
    env = spark.sparkContext.environment
    for name, value in memory.items():
        if env.get(name) in (None, LEAN[name], ROOMY[name]):
            env[name] = value
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; only where it is unset on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing done so far."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, hours: float = 24.0) -> list[str]:
    """Deletes intermediate tables and files of this subpackage in the shared folder that nothing has written for so long; returns their names.

    Results read them until they are written themselves, so only the caller knows when they have had their time.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry/*")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in system.globStatus(path) or [] if x.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for p in old:
        system.delete(p, True)
    return sorted(p.getName() for p in old)


def give_back() -> None:
    """Returns freed memory of this process to the system, where the allocator can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc32_mod(column: str, by: int):
    """crc32 of an id written as text, modulo by: how the folds are dealt."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
