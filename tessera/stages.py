"""Stages of a long run: each written once, taken up again after a stop, deleted once consumed.

A stage is a name, the stages it reads, and a function of their DataFrames. Its rows are
written below the run's folder and committed by a marker that names them and the run's
key (a text of inputs and parameters). A run that was killed goes on from the committed
stages its result still needs; what was written without a marker, or under another key,
is deleted and made again. A stage's rows go as soon as every stage that reads them is
committed, and all of the folder when the result has been used. A stage's shuffle files go when it is written.

Every commit is one small file, created under another name and renamed, so a reader sees
it whole or not at all. Two runs must not share a folder at the same time.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MARKER = "_committed"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []  # the temporary folder of a local driver


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Only on a local master, as in tests, may the setting be absent; a folder that goes with
    the driver is used then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-graph-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, a query's shuffle files are deleted at its end; else they stay until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


class Folder:
    """Files below a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> str:
        return "/".join((self.path, *parts))

    def exists(self, *parts: str) -> bool:
        return self._store.exists(self._at(self.at(*parts)))

    def names(self, *parts: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._store.listStatus(self._at(self.at(*parts)))) if self.exists(*parts) else []

    def delete(self, *parts: str) -> None:
        self._store.delete(self._at(self.at(*parts)), True)

    def read(self, *parts: str) -> str:
        source = self._store.open(self._at(self.at(*parts)))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def put(self, text: str, *parts: str) -> None:
        """A small file, there whole or not at all; replaces one of that name."""
        draft, final = self._at(self.at(*parts) + f".{uuid.uuid4().hex}"), self._at(self.at(*parts))
        sink = self._store.create(draft, True)
        sink.write(bytearray(text.encode()))
        sink.close()
        self._store.delete(final, False)
        if not self._store.rename(draft, final):
            raise OSError(f"can't create {final}")


class Stages:
    """The stages of one run. ``key`` tells runs over other inputs or parameters apart."""

    def __init__(self, spark: SparkSession, path: str, key: str = ""):
        self.spark, self.key = spark, key
        self.folder = Folder(spark, path)
        self._made: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}

    def add(self, name: str, make: Callable[..., DataFrame], *reads: str) -> None:
        """A stage made from the rows of earlier ones."""
        unknown = [r for r in reads if r not in self._made]
        if unknown or name in self._made or not name.replace("_", "").isalnum():
            raise ValueError(f"stage {name!r} reads unknown {unknown}" if unknown else f"stage {name!r} can't be added")
        self._made[name] = (make, reads)

    def _marked(self, name: str) -> str | None:
        """Where a committed stage's rows are, or None."""
        if not self.folder.exists(name, MARKER):
            return None
        at, _, key = self.folder.read(name, MARKER).partition("\n")
        return at if key == self.key else None

    def committed(self) -> list[str]:
        return [n for n in self._made if self._marked(n)]

    def _rows(self, name: str) -> DataFrame:
        at = self._marked(name)
        return self.spark.read.parquet(self.folder.at(name, at))

    def _needed(self, targets: tuple[str, ...]) -> list[str]:
        """Stages to make for the targets, in order: those whose rows are wanted by one that isn't committed."""
        found: list[str] = []

        def visit(name: str) -> None:
            if name not in found and not self._marked(name):
                for r in self._made[name][1]:
                    visit(r)
                found.append(name)

        for target in targets:
            visit(target)
        return found

    def _consume(self, needed: list[str], targets: tuple[str, ...]) -> None:
        """Deletes the rows that no stage still to be made reads."""
        wanted = {r for n in needed for r in self._made[n][1]} | set(targets)
        for name in self.committed():
            if name not in wanted:
                self.folder.delete(name)

    def _commit(self, *targets: str) -> None:
        """Makes the targets from whatever is committed."""
        for name in self.folder.names():  # leavings of a stopped run, or of one under another key
            if not self._marked(name):
                self.folder.delete(name)
        needed = self._needed(targets)
        for k, name in enumerate(needed):
            make, reads = self._made[name]
            at = f"rows-{uuid.uuid4().hex}"
            with shuffles_freed(self.spark):
                make(*(self._rows(r) for r in reads)).write.parquet(self.folder.at(name, at))
            self.folder.put(f"{at}\n{self.key}", name, MARKER)
            self._consume(needed[k + 1 :], targets)

    def run(self, target: str) -> DataFrame:
        """The target's rows, made from whatever is committed."""
        self._commit(target)
        return self._rows(target)

    def unwritten(self, target: str) -> DataFrame:
        """The target's rows, made as they are read from the stages it reads, which are committed.

        For a result that the caller writes anyway: it would be on the disk twice.
        """
        if self._marked(target):
            return self._rows(target)
        make, reads = self._made[target]
        self._commit(*reads)
        with shuffles_freed(self.spark):  # of what is counted to choose a plan
            return make(*(self._rows(r) for r in reads))

    @contextmanager
    def result(self, target: str) -> Iterator[DataFrame]:
        """The target's rows for the length of the block; when it ends well, the run's folder is deleted."""
        yield self.run(target)
        self.folder.delete()
