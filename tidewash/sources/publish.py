"""Tables that readers see whole or not at all, whatever happens to their writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewash.sources.tables import write_cleaned

KEPT_VERSIONS = 2


class Published:
    """A folder of versions and of numbered manifests; the newest manifest names the version that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.fs_path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def manifests(self) -> list[tuple[int, str, str]]:
        """(number, version, format) of all manifests, oldest first."""
        names = [n.split("-", 2) for n in self._names("manifests") if not n.startswith((".", "_"))]
        return sorted((int(number), version, fmt) for number, fmt, version in names)

    def add(self, version: str, fmt: str) -> int:
        """Makes a version the current one; of two writers at a time the later number counts."""
        folder = self.fs_path(f"{self.path}/manifests")
        self.fs.mkdirs(folder)
        number = max((n for n, _, _ in self.manifests()), default=0) + 1
        # The name says all, and an empty file is there at once; it is never written again.
        while not self.fs.createNewFile(self.fs_path(f"{self.path}/manifests/{number:012d}-{fmt}-{version}")):
            number += 1
        return number

    def version(self, name: str) -> str:
        return f"{self.path}/versions/{name}"

    def drop_old(self, kept: int) -> None:
        """Deletes all but the newest versions, manifests first; a version without one belongs to a writer at work."""
        for number, name, fmt in self.manifests()[:-kept]:
            self.fs.delete(self.fs_path(f"{self.path}/manifests/{number:012d}-{fmt}-{name}"), False)
            self.fs.delete(self.fs_path(self.version(name)), True)


def publish(df: DataFrame, path: str, fmt: str = "parquet", kept: int = KEPT_VERSIONS, write: Callable[[DataFrame, str, str], None] = write_cleaned) -> str:
    """Writes ``df`` as a new version of the table at ``path`` and makes it the current one; returns its folder.

    The switch is a single file made after the version is complete. A write that fails, or a
    driver that is lost, leaves the former version readable. ``df`` may read the table itself.
    """
    if kept < 1:
        raise ValueError("the current version is kept")
    folder, name = Published(df.sparkSession, path), uuid.uuid4().hex
    try:
        write(df, folder.version(name), fmt)
    except Exception:
        folder.fs.delete(folder.fs_path(folder.version(name)), True)
        raise
    folder.add(name, fmt)
    folder.drop_old(kept)
    return folder.version(name)


def read_published(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The current version of a published table; CSV comes as texts under its header."""
    folder = Published(spark, path)
    if not (found := folder.manifests()):
        raise FileNotFoundError(f"nothing was published at {path}")
    _, name, fmt = found[-1]
    own = {"header": "true", "escape": '"', "multiLine": "true"} if fmt == "csv" else {}
    return spark.read.format(fmt).options(**{**own, **options}).load(folder.version(name))
