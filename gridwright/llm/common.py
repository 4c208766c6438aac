"""What the training-data operators share: shared-folder tables, row keys, word rules."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Paths of this process's stashed tables, oldest first.
STASHED: list[str] = []
#: Bits of a sieve, as a power of two, at most: 8 MB.  A fuller sieve passes more rows, never fewer.
SIEVE = 26


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridwright-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, survives lost executors (unlike localCheckpoint) and
    fixes what a later pass sees.  Tables lie under one folder per application.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    STASHED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove stashed tables once their results are consumed: those from place ``since`` on, but ``keep``'s."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    kept = [] if keep is None else [f.split("://", 1)[-1] for f in keep.inputFiles()]
    for path in STASHED[since:]:
        bare = path.split("://", 1)[-1].split(":", 1)[-1]
        if not any(f"{bare}/" in f for f in kept):
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            STASHED.remove(path)


def id_or_digest(id_col: str, text_col: str) -> Column:
    """The row's id; for a null id a negative one made from the text, so equal rows share it."""
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieve(hashes: DataFrame, name: str = "marks") -> tuple[DataFrame, Callable[[Column], Column]]:
    """A broadcast row of marks and the condition by which a 64-bit hash passes: all of ``hashes``, its one column, do.

    Of other hashes a twelfth or so pass too, so a join on the hash has to follow;
    what the sieve holds back need not be shuffled for it.
    """
    spark, (of,) = hashes.sparkSession, hashes.columns
    size = min(SIEVE, max(10, math.ceil(math.log2(8 * hashes.count() + 1))))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))

    at = F.shiftrightunsigned(F.col(of), 64 - size)
    found = hashes.select(F.shiftright(at, 6).alias("word"), bit(at).alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (size - 6), np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    row = spark.createDataFrame(pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))}))

    def passes(h: Column) -> Column:
        place = F.shiftrightunsigned(h, 64 - size)
        word = F.col(name)[F.shiftright(place, 6).cast("int")]
        return word.bitwiseAND(bit(place)) != 0

    return F.broadcast(row), passes


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_blas_thread() -> None:
    """Keep numpy's linear algebra on this thread.

    The driver forks (to start the JVM) after numpy has loaded; thread pools of
    OpenBLAS can hang after that.  On executors one thread is a task's share.
    """
    import ctypes
    import re

    try:
        with open("/proc/self/maps") as maps:
            paths = set(re.findall(r"(/\S*openblas\S*\.so\S*)", maps.read()))
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
