"""Results of runs that count as a whole or not at all."""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from credsieve.scratch import file_system, remove


class RunStore:
    """Tables that grow by runs: detections, ledger rows and whatever else a run returns.

    A run writes its tables to folders of its own, which nobody reads yet. Then a new
    manifest that lists them, beside those of all earlier runs, is put in place by one
    rename that fails if another writer was faster. So a run's tables appear together, a
    run that broke off between two of them leaves nothing to be read, and one that is
    done over adds nothing twice. The columns are checked against the manifest that the
    new one replaces, so two writers cannot both pass the check with different columns.

    The folder must lie in a file system whose rename is atomic (HDFS, a local disk).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests --

    def _latest(self):
        """(number, {run: {table: {"folder", "schema"}}}); (0, {}) before the first run."""
        system, folder = file_system(self.spark, f"{self.path}/manifest")
        if not system.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        number = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not number:
            return 0, {}
        return number, json.loads(self._text(self._manifest(number)))

    def _manifest(self, number):
        return f"{self.path}/manifest/{number:012d}.json"

    def _text(self, path):
        system, target = file_system(self.spark, path)
        stream = system.open(target)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, number, runs) -> bool:
        """Put manifest ``number`` in place; false if there is one already."""
        jvm, temporary = self.spark._jvm, f"{self.path}/manifest/.new-{uuid.uuid4().hex}"
        system, source = file_system(self.spark, temporary)
        stream = system.create(source, True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        target = jvm.org.apache.hadoop.fs.Path(self._manifest(number))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            system.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_replace = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_replace[0] = rename.NONE
        try:
            context.rename(source, target, never_replace)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            system.delete(source, False)
            return False
        return True

    # -- runs --

    def runs(self) -> list[str]:
        """Names of the committed runs, in the order of their commits."""
        return list(self._latest()[1])

    def commit(self, run: str, tables: dict[str, DataFrame]) -> bool:
        """Add the tables of a run; false, and nothing is written, if the run counts already.

        A table whose columns differ from those of an earlier run, in name, order or type,
        is refused, and the run as a whole with it.
        """
        if run in self._latest()[1]:
            return False
        folder = f"{self.path}/data/{run}-{uuid.uuid4().hex}"
        entry = {}
        for name, table in tables.items():
            schema = _nullable(table.schema)
            entry[name] = {"folder": f"{folder}/{name}", "schema": schema}
        try:
            self._check(self._latest()[1], entry)
            for name, table in tables.items():
                table.write.parquet(entry[name]["folder"])
            return self._enter(run, entry)
        except Exception:
            remove(self.spark, folder)
            raise

    def _enter(self, run, entry):
        while True:
            number, runs = self._latest()
            if run in runs:
                remove(self.spark, next(iter(entry.values()))["folder"].rpartition("/")[0])
                return False
            self._check(runs, entry)
            if self._publish(number + 1, runs | {run: entry}):
                return True

    def _check(self, runs, entry):
        for name, own in entry.items():
            for earlier in runs.values():
                if name in earlier and earlier[name]["schema"] != own["schema"]:
                    had = [f["name"] for f in earlier[name]["schema"]["fields"]]
                    have = [f["name"] for f in own["schema"]["fields"]]
                    raise ValueError(f"{self.path}: {name} has columns {had}, the rows have {have}")

    def read(self, name: str) -> DataFrame | None:
        """A table over all committed runs; None if no run had it."""
        entries = [tables[name] for tables in self._latest()[1].values() if name in tables]
        if not entries:
            return None
        schema = StructType.fromJson(entries[-1]["schema"])
        return self.spark.read.schema(schema).parquet(*(e["folder"] for e in entries))

    def merge(self, name: str) -> None:
        """Rewrite a table of many small runs as one folder. The old folders stay for those
        who read them now, until ``tidy``."""
        number, runs = self._latest()
        entries = [(run, tables[name]) for run, tables in runs.items() if name in tables]
        if len(entries) < 2:
            return
        folder = f"{self.path}/data/merged-{uuid.uuid4().hex}/{name}"
        self.read(name).write.parquet(folder)
        merged = {run: dict(tables) for run, tables in runs.items()}
        for run, _ in entries[:-1]:
            del merged[run][name]
        merged[entries[-1][0]][name] = {"folder": folder, "schema": entries[-1][1]["schema"]}
        if not self._publish(number + 1, merged):
            remove(self.spark, folder.rpartition("/")[0])
            self.merge(name)

    def tidy(self) -> None:
        """Remove folders that the manifest does not list: of runs that broke off and of
        tables that were merged. Not while another run is writing or reading old ones."""
        listed = {t["folder"] for tables in self._latest()[1].values() for t in tables.values()}
        system, data = file_system(self.spark, f"{self.path}/data")
        for run in system.listStatus(data) if system.exists(data) else []:
            for table in system.listStatus(run.getPath()):
                path = f"{self.path}/data/{run.getPath().getName()}/{table.getPath().getName()}"
                if path not in listed:
                    remove(self.spark, path)


def _nullable(schema) -> dict:
    """A schema as JSON value, all columns nullable, as files do not keep that apart."""
    text = json.dumps(schema.jsonValue())
    for old, new in (('"nullable": false', '"nullable": true'), ('"containsNull": false', '"containsNull": true')):
        text = text.replace(old, new)
    return json.loads(text.replace('"valueContainsNull": false', '"valueContainsNull": true'))
