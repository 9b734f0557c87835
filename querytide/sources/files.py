"""Small files in shared folders, read and written by the driver through Hadoop's file systems.

They hold what a table needs besides its rows: which version is current, where a batch left off. None grows with the
data.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class SharedFiles:
    """Files in one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(folder)
        self.system = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.is_local = self.system.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.path(self.folder, name)

    def names(self) -> list[str]:
        """Names in the folder, hidden ones left out; none where there is no folder."""
        if not self.system.exists(self.folder):
            return []
        found = (status.getPath().getName() for status in self.system.listStatus(self.folder))
        return sorted(name for name in found if not name.startswith((".", "_")))

    def read(self, name: str) -> str | None:
        if not self.system.exists(self._at(name)):
            return None
        stream = self.system.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, place, text: str) -> None:
        stream = self.system.create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create the file with its text if there is none of that name, as one step: of several that try at once, one
        succeeds, and nobody sees half a file."""
        self.system.mkdirs(self.folder)
        draft = self._at(f".{name}-{uuid.uuid4().hex}")
        self._write(draft, text)
        try:
            if not self.is_local:
                # A rename does not replace a file, other than on a local disk.
                return not self.system.exists(self._at(name)) and self.system.rename(draft, self._at(name))
            try:
                os.link(draft.toUri().getPath(), self._at(name).toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            self.system.delete(draft, False)

    def write(self, name: str, text: str) -> None:
        """Write the file, or replace it."""
        self._write(self._at(name), text)

    def delete(self, name: str) -> bool:
        """Delete a file or a folder with all it holds."""
        return self.system.delete(self._at(name), True)

    def age_millis(self, name: str) -> int:
        return self.jvm.System.currentTimeMillis() - self.system.getFileStatus(self._at(name)).getModificationTime()

    def stamp(self, name: str, millis: int) -> None:
        """Set the time of a file's last change, by which file streams order their input."""
        self.system.setTimes(self._at(name), millis, -1)


class VersionLog:
    """Numbered versions of something, each a line of text. Writers that race for a number find out who was first."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = SharedFiles(spark, folder)

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:020d}"

    def versions(self) -> list[int]:
        return [int(name) for name in self.files.names() if name.isdigit()]

    def newest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int) -> str | None:
        return self.files.read(self._name(version))

    def claim(self, version: int, text: str) -> bool:
        """Make this the text of a new version, unless somebody else already has."""
        return self.files.create(self._name(version), text)

    def forget(self, version: int) -> None:
        self.files.delete(self._name(version))

    def age_millis(self, version: int) -> int:
        return self.files.age_millis(self._name(version))
