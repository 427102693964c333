"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a numpy kernel handles at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (local runs only) a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-cairn-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Shuffle files of a finished write are of no more use: what it gave stands in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Hashes don't compress; pages of the second version store them in as many bits as they have.
HASHES = {"compression": "uncompressed", "parquet.writer.version": "v2"}


def saved(df: DataFrame, name: str = "step", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(options or {"compression": "snappy"})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these steps; nothing that is still to be computed may read them."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._cairn_path)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Python workers on this machine find the package beside this file; on a cluster it comes with --py-files."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed split into folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def byte_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the row offsets into them; null rows are empty."""
    o = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    if o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=int(o[-1]))[int(o[0]) :]
    return data, o - o[0]


def gather(flat_values: np.ndarray, starts: np.ndarray, lens: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Concatenation of the runs ``flat_values[starts[i] : starts[i] + lens[i]]`` for i in ``idx``."""
    n = lens[idx]
    total = int(n.sum())
    if not total:
        return flat_values[:0]
    first = np.cumsum(n) - n
    return flat_values[np.repeat(starts[idx] - first, n) + np.arange(total)]


class Memo(dict):
    """Numbers distinct white-space-delimited chunks in order of arrival; ``new`` are those not yet computed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        i = self[chunk] = len(self)
        self.new.append(chunk)
        return i


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def rested(run):
    """``run`` for mapInArrow; at the end of a task the worker, which may stand idle next to other operators, gives back what it doesn't use."""

    def resting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        give_back()

    return resting


#: A batch goes to a Python worker with so many bytes at most (or one row): Spark's own limit, 10,000 rows or 64 MB, holds tens of MB of texts
#: several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches are of BATCH_BYTES at most, unless it has smaller ones; it is a setting of the session, as a step may be computed by who gets it."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", spark.conf.get(_BATCHES).lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")


def unsigned_crc32(col: Column) -> Column:
    return F.crc32(col.cast("binary"))


#: What each operator keeps in this worker between tasks, and how it is given up.
_KEPT: dict[str, object] = {}


def claim(owner: str, clear=None) -> None:
    """Called where an operator's work begins in a worker: what other operators keep there goes; ``clear`` gives up what this one will keep."""
    for other in [k for k in _KEPT if k != owner]:
        _KEPT.pop(other)()
        gc.collect()
    if clear:
        _KEPT[owner] = clear
