"""What a folder of tables holds at the moment, as a small state that is swapped at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_ledger"


class Ledger:
    """Numbered states (JSON) below a shared folder; readers see the last one, whole.

    A state is written aside and renamed into place, which the file systems that Spark writes to do at
    once.  A number is given once: who comes second gets FileExistsError and reads again.  States name
    folders, days and steps, so they grow with those and not with rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        path, fs = self._path(FOLDER)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The last state (or a given one) and its number; 0 and nothing before the first."""
        version = version or (self.versions() or [0])[-1]
        if not version:
            return 0, {}
        path, fs = self._path(FOLDER, f"{version:012d}.json")
        stream = fs.open(path)
        try:
            return version, json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, version: int, state: dict) -> None:
        """Makes a state the one after ``version``."""
        aside, fs = self._path(FOLDER, f".{uuid.uuid4().hex}")
        place, _ = self._path(FOLDER, f"{version + 1:012d}.json")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise FileExistsError(f"another writer made state {version + 1} of {self.root}")

    def folders(self, *below: str) -> list[str]:
        """Full names of what lies below the root, by a pattern."""
        path, fs = self._path(*below)
        return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))

    def delete(self, folder: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self._conf).delete(path, True)
