"""Where jobs keep what several stages share: tables and plain binary files.

Everything goes below ``spark.checkpoint.dir``, the one folder that the driver and all executors see.
The setting is read from the session. Where a session has none, a local one (tests, a laptop) gets a temporary
folder; any other uses the warehouse, which all machines of a cluster see.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="quoteloom-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quoteloom/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a reader of that table.

    This cuts the lineage: a lost executor costs the tasks it ran, never the table. The shuffle files of the write are
    of no use once the table is whole, so this session is told to remove them then, not when the driver collects garbage.
    """
    path = fresh_path(df.sparkSession, label)
    df.sparkSession.conf.set(CLEANUP, "true")
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quoteloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``keep`` wrote and that no later plan reads."""
    for table in tables:
        path = getattr(table, "_quoteloom_path", None)
        if hasattr(table, "_quoteloom_table"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._quoteloom_table}")
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def write_bytes(uri: str, parts) -> int:
    """Writes the byte strings ``parts`` to ``uri`` and returns their length.

    The bytes go to a name of this attempt first and are renamed at the end, so a task that is run twice,
    or that dies half-way, never leaves a half-written file under the final name.
    """
    filesystem, path = open_fs(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt, size = f"{path}.{uuid.uuid4().hex}", 0
    with filesystem.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    filesystem.move(attempt, path)
    return size


def read_bytes(uri: str):
    """The whole file as a buffer; memory-mapped where the store is a local disk."""
    import pyarrow as pa
    from pyarrow import fs

    filesystem, path = open_fs(uri)
    if isinstance(filesystem, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with filesystem.open_input_file(path) as f:
        return f.read_buffer()


class Scratch:
    """Tables that one job shares between its steps: ``keep`` as above, ``clear`` when the result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
        self.tables.append(keep(df, label, compression))
        return self.tables[-1]

    def bucketed(self, df: DataFrame, key: str, label: str, split: int = 1, compression: str = "lz4") -> DataFrame:
        """As ``keep``, with the table's files dealt by ``key``, so that later steps aggregate by it without a shuffle.

        ``split``: files for each shuffle partition; a later task reads one file and so has that much less to hold.
        """
        spark = df.sparkSession
        spark.conf.set(CLEANUP, "true")
        path, name = fresh_path(spark, label), f"quoteloom_{label}_{uuid.uuid4().hex}"
        buckets = split * int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, key).option("path", path).option("compression", compression).format("parquet").saveAsTable(name)
        out = spark.table(name)
        out._quoteloom_path, out._quoteloom_table = path, name
        self.tables.append(out)
        return out

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()


#: A side of a join is broadcast if its rows are counted and take no more than this in a task.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    """What a row of fixed-size columns takes in a broadcast hash table; strings and arrays count as 64 bytes more."""
    return 48 + sum(8 if f.dataType.typeName() in ("long", "integer", "double", "boolean", "date", "timestamp") else 72 for f in df.schema.fields)


def matching(df: DataFrame, ids: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``ids`` on ``keys``: by broadcast if the counted ids are small enough, else by a shuffle.

    The shuffled join sorts, so adaptive execution can split a key with very many rows.
    """
    return df.join(F.broadcast(ids) if ids.count() * row_bytes(ids) <= BROADCAST_BYTES else ids.hint("merge"), list(keys), how)


def only(df: DataFrame, ids: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``keys`` are in ``ids``."""
    return matching(df, ids, *keys, how=how)


def without(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are not in ``ids``."""
    return matching(df, ids, *keys, how="left_anti")
