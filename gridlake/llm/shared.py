"""The folder that all executors share: tables and files that later jobs read.

Everything here is written under ``spark.checkpoint.dir`` when the session has it. Only where it is unset and the
master is local (tests, one machine) a folder of our own is made. Files are written under a name of the task attempt and
then renamed, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, from the session's ``spark.checkpoint.dir``."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "gridlake-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI; it goes when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clear)
    _made[at] = spark
    return at


def drop(at: str) -> None:
    """Remove a folder that new_path() named."""
    spark = _made.pop(at, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear() -> None:
    for at in list(_made):
        try:
            drop(at)
        except Exception:  # noqa: BLE001  the session is going down; nothing reads the folder any more
            _made.pop(at, None)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: later jobs neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    made = spark.read.schema(df.schema).parquet(at)
    made._gridlake_at = at
    return made


def spent(*tables: DataFrame) -> None:
    """Remove tables that table() made and that no later job reads."""
    for t in tables:
        drop(t._gridlake_at)


def apart(df: DataFrame) -> DataFrame:
    """Rows dealt anew in even parts: a join then shuffles this side by its own keys, so that Spark can split a hot key of
    the join's other side instead of taking over the partitions of an aggregate."""
    return df.hint("rebalance")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, from any process."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class SharedFile:
    """A stream to a file beside uri that close() renames to uri; without close() nothing appears at uri."""

    def __init__(self, uri: str):
        self.files, self.path = filesystem(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"
        self.stream = self.files.open_output_stream(self.part)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.part, self.path)


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers as bytes, each at a multiple of 8; unpack_arrays gives views of them."""
    head = json.dumps([[x.dtype.str, len(x)] for x in arrays]).encode()
    padded = lambda x: x + bytes(-len(x) % 8)
    return b"".join([np.int64(len(head)).tobytes(), padded(head), *(padded(np.ascontiguousarray(x).tobytes()) for x in arrays)])


def unpack_arrays(data: pa.Buffer) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8 + n + -n % 8, []
    for kind, count in json.loads(bytes(data.slice(8, n))):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes + -out[-1].nbytes % 8
    return out


class Mapped:
    """Shared files by URI, opened as what make() gives for their bytes. Local files are mapped, so that processes of a
    machine share their pages; others are held up to a number of bytes, the oldest going first."""

    def __init__(self, make, most_bytes: int):
        self.make, self.most_bytes = make, most_bytes
        self.open: dict[str, tuple[object, int]] = {}
        self.size = 0

    def __getitem__(self, uri: str):
        if uri not in self.open:
            files, path = filesystem(uri)
            mapped = files.type_name == "local"
            data = (pa.memory_map(path) if mapped else files.open_input_file(path)).read_buffer()
            held = 0 if mapped else len(data)
            while held and self.size + held > self.most_bytes and self.open:
                self.size -= self.open.pop(next(iter(self.open)))[1]
            self.open[uri] = self.make(data), held
            self.size += held
        return self.open[uri][0]


def width(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle partitions, or more."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
