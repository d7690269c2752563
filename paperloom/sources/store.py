"""A library kept as Parquet folders, one for each table; files as a folder read in binary.

A table is a folder of snapshots. A change writes a whole new snapshot and then a small file that names it; that file is
written under another name and renamed, so readers see the old snapshot or the new one, and a crash at any point leaves the table as
it was. Appends add files to the present snapshot. Older snapshots stay until clean() removes them, so that
running readers are not cut off.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.schema import schema


def file_path(kb_id, name):
    """Path of a stored file: kb/{kb_id}/{eight letters}-{name}; the letters are a hash, so a retry writes the same file."""
    return F.concat(F.lit("kb/"), kb_id.cast("string"), F.lit("/"), F.substring(F.md5(F.concat_ws("/", kb_id.cast("string"), name).cast("binary")), 1, 8), F.lit("-"), name)


@dataclass
class Store:
    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        """A table with its declared schema; one never written is empty."""
        path = self._present(name)
        if path is None:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        path = self._present(name)
        if path is None:
            self.replace(name, rows)
        else:
            self._fit(name, rows).write.mode("append").parquet(path)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the whole table anew as the next snapshot, then name it. rows may read the table itself."""
        number = self._number(name) + 1
        fresh = f"{self.root}/{name}/snapshot-{number:08d}-{uuid.uuid4().hex[:8]}"
        self._fit(name, rows).write.parquet(fresh)
        self._put(f"{self.root}/{name}/present-{number:08d}", fresh.rsplit("/", 1)[1].encode())

    def clean(self, name: str) -> None:
        """Remove all snapshots but the present one, and the names of older ones."""
        now = self._present(name)
        newest = f"present-{self._number(name):08d}"
        for entry in self._list(f"{self.root}/{name}"):
            if entry not in (newest, (now or "").rsplit("/", 1)[-1]):
                self._delete(f"{self.root}/{name}/{entry}")

    def _list(self, folder: str) -> list[str]:
        fs = self._fs(folder)
        target = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _number(self, name: str) -> int:
        """Of the newest snapshot that is named; 0 where there is none."""
        found = [int(e[8:]) for e in self._list(f"{self.root}/{name}") if e.startswith("present-")]
        return max(found, default=0)

    def _present(self, name: str) -> str | None:
        number = self._number(name)
        if not number:
            return None
        target = f"{self.root}/{name}/present-{number:08d}"
        stream = self._fs(target).open(self._path(target))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return f"{self.root}/{name}/{text.strip()}"

    def _put(self, target: str, data: bytes) -> None:
        """A small file, whole or not at all: written under another name, then renamed; it fails if another took the name first."""
        fs, waiting = self._fs(target), f"{target}.{uuid.uuid4().hex[:8]}.tmp"
        stream = fs.create(self._path(waiting), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if fs.exists(self._path(target)) or not fs.rename(self._path(waiting), self._path(target)):
            fs.delete(self._path(waiting), False)
            raise OSError(f"{target} is there already")

    def put_file(self, kb_id: int, name: str, data: bytes) -> str:
        """Store a file; its path under the root. A file of the same name takes its place."""
        letters = hashlib.md5(f"{kb_id}/{name}".encode()).hexdigest()[:8]
        path = f"kb/{kb_id}/{letters}-{name}"
        self._delete(f"{self.root}/{path}")
        self._put(f"{self.root}/{path}", data)
        return path

    def files(self, pattern: str = "*") -> DataFrame:
        """(path, modificationTime, length, content) of stored files; leave out content to list them."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{self.root}/kb")

    def delete_file(self, path: str) -> bool:
        """Remove one file; false where there was none."""
        return self._delete(f"{self.root}/{path}")

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> bool:
        return bool(self._fs(path).delete(self._path(path), True))
