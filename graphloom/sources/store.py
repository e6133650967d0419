"""Revisions of graph tables: immutable Parquet folders, the newest of which is the published one.

publish() writes all tables of a revision to a folder of its own and then renames that folder to the revision's number.
The rename is what publishes: readers see all of a revision or none of it, and of two publishers that start from one
revision the second finds the number taken and fails (compare and swap). A failed publisher leaves no trace.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RevisionConflict(RuntimeError):
    pass


class NotFresh(RuntimeError):
    pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without, in a temporary one."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    root = now.get() if now.nonEmpty() else sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
    if now.isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        """The published revision's number; 0 before the first."""
        fs, p = self._fs(f"{self.root}/revisions")
        if not fs.exists(p):
            return 0
        return max([int(x.getPath().getName()) for x in fs.listStatus(p)], default=0)

    def publish(self, tables: dict[str, DataFrame], base: int) -> int:
        """Writes tables as revision base + 1; RevisionConflict if base is no longer the published one."""
        new = base + 1
        if self.current() != base:
            raise RevisionConflict(f"revision {self.current()} is published, not {base}")
        own = f"{self.root}/staging/{uuid.uuid4().hex}"
        fs, source = self._fs(own)
        try:
            for name, df in tables.items():
                df.write.parquet(f"{own}/{name}")
            parent, target = self._fs(f"{self.root}/revisions")[1], self._fs(f"{self.root}/revisions/{new}")[1]
            fs.mkdirs(parent)
            if self.current() != base:
                raise RevisionConflict(f"revision {new} is already published")
            self._rename(source, target)
        finally:
            if fs.exists(source):
                fs.delete(source, True)
        return new

    def _rename(self, source, target) -> None:
        """A rename that never replaces or nests, unlike that of FileSystem."""
        from py4j.protocol import Py4JJavaError

        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs = target.getFileSystem(conf)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), none)
        except Py4JJavaError as e:
            if fs.exists(target):
                raise RevisionConflict(f"{target} is already published") from e
            raise

    def read(self, name: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/revisions/{revision or self.current()}/{name}")

    def revoke(self, revision: int) -> None:
        """Says that a revision is no longer fresh, as something has changed that it doesn't show. Readers find it stale from
        now on; the next revision is fresh again."""
        fs, p = self._fs(f"{self.root}/revoked/{revision}")
        fs.create(p, True).close()

    def revoked(self, revision: int) -> bool:
        fs, p = self._fs(f"{self.root}/revoked/{revision}")
        return fs.exists(p)

    def wait(self, beyond: int, seconds: float = 30.0, every: float = 0.1) -> int | None:
        """The first revision after `beyond` that isn't revoked, as soon as there is one; None when time is up."""
        end = time.monotonic() + seconds
        while True:
            now = self.current()
            if now > beyond and not self.revoked(now):
                return now
            if time.monotonic() >= end:
                return None
            time.sleep(every)

    def require(self, at_least: int) -> int:
        """The published revision; NotFresh if it is older than at_least."""
        now = self.current()
        if now < at_least:
            raise NotFresh(f"revision {now} is published, {at_least} is asked for")
        return now

    def changes(self, name: str, old: int, new: int) -> DataFrame:
        from graphloom.operators.delta import revision_delta

        return revision_delta(self.read(name, old), self.read(name, new)).withColumn("revision", F.lit(new))
