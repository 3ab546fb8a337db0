"""Shared plumbing of the text operators: inputs, blocks, shipping, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one block of documents aims at; bounds a Python worker's memory.
BLOCK_BYTES = 8 << 20

#: Checkpoints after which the driver collects its garbage: only then does Spark remove the files of earlier rounds' shuffles
#: and checkpoints, which otherwise stay for half an hour.
CLEAN_EVERY = 8
_checkpoints = 0

_ROOT = Path(__file__).resolve().parents[2]


#: Rows of an Arrow batch, of Spark's own 10,000: a batch of texts is held by the JVM and the worker, each twice for a while.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it on their path, and bound batches of texts."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(_ROOT) in paths or os.getcwd() == str(_ROOT) or getattr(spark, "_tetrad_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "tetrad.zip"  # Spark copies it to every executor
    with zipfile.ZipFile(out, "w") as z:
        for p in (_ROOT / "tetrad").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(out))
    spark._tetrad_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session.

    The folder is ``spark.checkpoint.dir``; a session without one gets a folder of its own if it is local (tests), since on
    a cluster executors could not read the driver's.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tetrad-ckpt-"))
    out = df.checkpoint()
    global _checkpoints
    _checkpoints += 1
    if _checkpoints % CLEAN_EVERY == 0:
        gc.collect()
        sc._jvm.System.gc()
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id long, text string, ...): a null text is empty, other columns are not looked at."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that hold the table's texts at about ``block_bytes`` each; one scan, one number to the driver."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 64).alias("n")).first()["n"] or 0
    return max(1, -(-total // block_bytes))


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """Deal rows of texts() to n blocks by a hash of (doc_id, text), so repeated ids spread as well."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def attached(rows: DataFrame, keys: list[str], spread: list[str], partial: list[Column], merged: list[Column], how: str = "inner", where: str = "true", tasks: int = 32) -> DataFrame:
    """Rows with the aggregates of their group, however large it is: a group is dealt to ``tasks`` tasks by its ``spread``
    columns, which each aggregate their share; only these few rows of a group meet, and return to where the shares are.

    ``partial`` aggregates rows, ``merged`` the results of partial; groups for which ``where`` does not hold have no row.
    """
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*spread), F.lit(tasks)).cast("int"))
    shares = dealt.groupBy(*keys, "__deal").agg(*partial)
    whole = shares.groupBy(*keys).agg(*merged).where(where)
    return dealt.join(shares.select(*keys, "__deal").join(whole, keys), [*keys, "__deal"], how).drop("__deal")


def record(columns: dict[str, pa.DataType], rows: dict) -> pa.RecordBatch:
    """A record batch of the columns, from lists or arrays."""
    return pa.RecordBatch.from_arrays([rows[k] if isinstance(rows[k], pa.Array) else pa.array(rows[k], t) for k, t in columns.items()], names=list(columns))


def ddl(columns: dict[str, pa.DataType]) -> str:
    """The Spark schema of Arrow columns, as DDL."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"`{k}` {names[v]}" for k, v in columns.items())


#: Bytes that a worker's memory of words may take, about; an entry counts its key and value and this much besides.
MOST_BYTES, ENTRY = 64 << 20, 120

_HELD: dict = {}


def held(key, make):
    """What a worker remembers for one operator. Workers serve all stages of a job: asking for another operator's memory
    frees this one's first, so that a worker never holds two."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        release()
        _HELD[key] = make()
    return _HELD[key]


def forget(key: str) -> None:
    """Called by an operator that remembers nothing: frees what another one has left."""
    held(key, lambda: True)


def release() -> None:
    """Give what is free back to the system: arrays of a few MB otherwise stay with the allocator."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Cache(dict):
    """A dict that fills itself in bulk and forgets everything once it holds ``most`` bytes, about.

    ``fill(keys) -> values`` is called once for all missing keys of a request, so that it can work in bulk. ``size`` tells
    the bytes of a value.
    """

    def __init__(self, fill, most: int = MOST_BYTES, size=len):
        super().__init__()
        self.fill, self.most, self.size, self.bytes = fill, most, size, 0

    def want(self, keys) -> None:
        keys = list(dict.fromkeys(keys))  # callers pass generators, which can be read but once
        missing = [k for k in keys if k not in self]
        if not missing:
            return
        if self.bytes > self.most:
            self.clear()
            self.bytes, missing = 0, keys
        values = self.fill(missing)
        self.bytes += sum(map(len, missing)) + sum(map(self.size, values)) + ENTRY * len(missing)
        self.update(zip(missing, values))

    def lists(self, rows: list[list]) -> list[list]:
        """The values of lists of keys. What is known is looked up once."""
        found = [list(map(self.get, r)) for r in rows]
        holes = [i for i, f in enumerate(found) if None in f]
        self.want(k for i in holes for k, x in zip(rows[i], found[i]) if x is None)
        for i in holes:
            found[i] = [self[k] if x is None else x for k, x in zip(rows[i], found[i])]
        return found


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for; ``new`` collects the unseen ones, ``bytes`` is about
    what all take."""

    def __init__(self):
        super().__init__()
        self.new: list = []
        self.bytes = 0

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        self.bytes += len(key) + ENTRY
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def taken(self) -> list:
        """The keys that are new since the last call."""
        new, self.new = self.new, []
        return new


def split_batch(batch: pa.RecordBatch, most: int = 4 << 20):
    """Slices of a batch whose text is at most ``most`` bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
