"""Files of a mounted (shared) file system, or of a store that a URI names.

The built-in file sources hide names that start with ``_`` or ``.``, such as
``__init__.py``. So the folders are walked level by level, each level one
distributed step over the folders found by the level before.
"""

import os
import stat
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.scratch import written
from credsieve.sources import stores

_ENTRY = (
    "path string, is_dir boolean, length bigint, modified_ms bigint, is_root boolean, error string"
)
_NAMES = [part.split()[0] for part in _ENTRY.split(", ")]
#: Entries of a listing that leave a task together, however large a folder is.
_BATCH_ENTRIES = 50_000
_BATCH_BYTES = 16 << 20
#: Files that one task reads, about. Spark would join tasks by the bytes of the paths.
FILES_A_TASK = 2_000


def _entry(path, is_root):
    try:
        info = os.stat(path)
    except OSError as error:
        return path, False, None, None, is_root, str(error)
    folder = stat.S_ISDIR(info.st_mode)
    return path, folder, info.st_size, int(info.st_mtime * 1000), is_root, None


def _entries(folder):
    """Entries of a folder; the folder itself with an error if it cannot be read."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                # links to folders are not followed: they may form a cycle
                if not (entry.is_symlink() and entry.is_dir()):
                    yield _entry(entry.path, False)
    except OSError as error:
        yield folder, False, None, None, False, str(error)


def _lister(open_store):
    def entries(folder):
        return stores.folder_entries(folder, open_store) if stores.is_uri(folder) else _entries(folder)

    def run(batches):
        for batch in batches:
            found = chain.from_iterable(map(entries, batch["path"]))
            while rows := list(islice(found, _BATCH_ENTRIES)):
                yield _frame(rows)

    return run


def _root_reader(open_store):
    def entry(path):
        return stores.root_entry(path, open_store) if stores.is_uri(path) else _entry(path, True)

    def run(batches):
        for batch in batches:
            yield _frame([entry(p) for p in batch["path"]])

    return run


def _frame(rows):
    whole = dict.fromkeys(("length", "modified_ms"), "Int64")
    return pd.DataFrame(rows, columns=_NAMES).astype(whole)


def file_suffix(path):
    """Text after the last dot of the file name; empty for names like ``.gitignore``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"^.+\.([^.]+)$", 1)


def walk(spark: SparkSession, paths, open_store=None) -> DataFrame:
    """All entries below the roots; ``error`` says why one could not be read.

    A root is a path on a mount or the URI of a store (``sources/stores.py``), whose
    entries are URIs too; ``open_store`` opens stores that pyarrow does not know.
    """
    roots = spark.createDataFrame(pa.table({"path": pa.array(list(paths), pa.string())}))
    level = written(roots.mapInPandas(_root_reader(open_store), _ENTRY), "listing")
    found = level
    cores = spark.sparkContext.defaultParallelism
    while count := (folders := level.where("is_dir").select("path")).count():
        # one folder may be huge, many are small: spread them by path
        spread = folders.repartition(min(count, 16 * cores), "path")
        level = written(spread.mapInPandas(_lister(open_store), _ENTRY), "listing")
        found = found.unionByName(level)
    return found


def list_files(spark: SparkSession, paths, extensions, open_store=None) -> DataFrame:
    """Files below the roots with one of the suffixes; a root that is a file always."""
    return listed_files(walk(spark, paths, open_store), extensions)


def listed_files(entries: DataFrame, extensions) -> DataFrame:
    """Files of a ``walk`` with one of the suffixes."""
    wanted = F.col("is_root") | file_suffix(F.col("path")).isin(list(extensions))
    files = entries.where(F.col("error").isNull() & ~F.col("is_dir") & wanted)
    return files.select("path", "length", "modified_ms").distinct()


def _read_text(path):
    """Text and error of a file; one of them is None."""
    try:
        with open(path) as handle:
            return handle.read(), None
    except (OSError, UnicodeDecodeError) as error:
        return None, str(error)


def _body_reader(open_store):
    def run(batches):
        reader = stores.Reader(open_store)
        for batch in batches:
            rows, size = [], 0
            for path, modified in zip(batch["path"], batch["modified_ms"]):
                text, error = reader.text(path) if stores.is_uri(path) else _read_text(path)
                rows.append((path, modified, text, error))
                size += len(text or "")
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "modified_ms", "content", "error"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "modified_ms", "content", "error"])

    return run


def read_bodies(df: DataFrame, open_store=None) -> DataFrame:
    """``path`` and ``modified_ms`` of each listed file with its whole text, or the
    ``error`` that kept it from being read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // FILES_A_TASK))
    spread = df.select("path", "modified_ms").repartition(tasks, "path")
    kinds = "path string, modified_ms bigint, content string, error string"
    return spread.mapInPandas(_body_reader(open_store), kinds)


def read_local_code(df: DataFrame, open_store=None) -> DataFrame:
    """Whole text of each listed file; a file that cannot be read is empty."""
    bodies = read_bodies(df, open_store)
    return bodies.select("path", F.coalesce("content", F.lit("")).alias("content"))
