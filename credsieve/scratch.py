"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credsieve.functions.common import let

CHECKPOINT_CONF = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; must be configured on the session."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return path.rstrip("/")


_runs = threading.local()


def _run_folders() -> list[str]:
    """Folders of the runs under way in this thread, the innermost last."""
    if not hasattr(_runs, "folders"):
        _runs.folders = []
    return _runs.folders


def file_system(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path as it takes it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = file_system(spark, path)
    system.delete(target, True)


@contextmanager
def run_folder(spark: SparkSession):
    """Tables written meanwhile lie in one folder, which is removed at the end, also
    after a failure: they may hold plain secrets."""
    folder = f"{scratch_dir(spark)}/credsieve/run-{uuid.uuid4().hex}"
    _run_folders().append(folder)
    try:
        yield
    finally:
        _run_folders().remove(folder)
        remove(spark, folder)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    runs = _run_folders()
    folder = f"{scratch_dir(spark)}/credsieve" if keep or not runs else runs[-1]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Key under which this process seals columns; it is never written.
_KEY = os.urandom(16).hex()
#: Makes the hashes under which rows are stored useless to others.
_SALT = os.urandom(16).hex()


def salted_hash(*columns: str):
    """Strings as one hash that only this process can make again: a stored table that is
    joined by it names no secret. Null if one of them is."""
    parts = [p for c in columns for p in (F.length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.unhex(F.sha2(F.concat(F.lit(_SALT), *parts), 256))


def _sealed(column: str, kind: str):
    """A column as AES-encrypted bytes; other than strings as JSON text first."""
    text = F.col(column) if kind == "string" else F.to_json(column)
    return F.aes_encrypt(text, F.lit(_KEY))


def _opened(column: str, kind: str):
    text = F.aes_decrypt(F.col(column), F.lit(_KEY)).cast("string")
    return text if kind == "string" else F.from_json(text, kind)


#: Digits that give the length of a text among others, and what stands for null.
_DIGITS, _NULL = 10, "-" * 10


def _packed(columns):
    """Strings as bytes one behind another, their lengths first: sealing costs as much for
    one string as for all of a row."""
    sizes = [F.lpad(F.octet_length(c).cast("string"), _DIGITS, "0") for c in columns]
    parts = [*[F.coalesce(s, F.lit(_NULL)) for s in sizes], *[F.coalesce(c, F.lit("")) for c in columns]]
    return F.concat(*[p.cast("binary") for p in parts])


def _unpacked(packed, columns):
    """A struct of the strings that ``_packed`` took."""

    def fields(bytes_):
        at, found = F.lit(len(columns) * _DIGITS + 1), []
        for i, column in enumerate(columns):
            size = F.substring(bytes_, i * _DIGITS + 1, _DIGITS).cast("string")
            length = F.when(size != _NULL, size.cast("int")).otherwise(0)
            text = F.substring(bytes_, at, length).cast("string")
            found.append(F.when(size != _NULL, text).alias(column))
            at = at + length
        return F.struct(*found)

    return let(packed, fields)


def written(df: DataFrame, name: str, keep: bool = False, seal=()) -> DataFrame:
    """Write ``df`` once and read it back: computed once, survives lost executors.

    ``keep``: the table outlives the run that makes it. A table that no run removes and
    that is not kept goes when the session ends. ``seal``: columns (strings, arrays or
    structs) that hold plain secrets; they are stored encrypted under a key that only this
    process knows, as a folder may outlive a process that is killed.
    """
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in seal}
    texts = [c for c, k in kinds.items() if k == "string"]
    sealed = {c: _sealed(c, k) for c, k in kinds.items()}
    if len(texts) > 1:
        sealed[texts[0]] = F.aes_encrypt(_packed([F.col(c) for c in texts]), F.lit(_KEY))
    left_out = texts[1:]
    df.withColumns(sealed).drop(*left_out).write.parquet(path)
    if not keep and not _run_folders():
        system, target = file_system(spark, path)
        system.deleteOnExit(target)
    schema = StructType()
    for f in df.schema:
        if f.name not in left_out:
            schema = schema.add(f.name, "binary" if f.name in kinds else f.dataType)
    table = spark.read.schema(schema).parquet(path)
    opened = {c: _opened(c, k) for c, k in kinds.items() if not left_out or c not in texts}
    if opened:
        table = table.withColumns(opened)
    if left_out:
        row = _unpacked(F.aes_decrypt(F.col(texts[0]), F.lit(_KEY)), texts)
        others = [F.col(f"`{c}`") for c in df.columns if c not in texts]
        table = table.select(*others, F.inline(F.array(row))).select(*[F.col(f"`{c}`") for c in df.columns])
    table.scratch_path = path
    return table
