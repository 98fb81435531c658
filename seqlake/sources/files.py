"""The file system that Hadoop paths name, through Spark's JVM."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import IoError


class Files:
    def __init__(self, spark: SparkSession, root: str, raw: bool = False):
        """raw: without the checksum files beside local ones, which are not replaced in one step with what they check."""
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._plain = raw and self._fs.getUri().getScheme() == "file"
        if self._plain:  # made here, as the class behind the scheme may be a subclass or a proxy
            uri = self._fs.getUri()
            self._fs = self._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
            self._fs.initialize(uri, conf)

    def _local(self, name: str) -> str:
        return self._path(name).toUri().getPath()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise IoError(f"{self.path(name)} does not exist")
        try:
            stream = self._fs.open(self._path(name))
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise IoError(f"cannot read {self.path(name)}") from e

    def write(self, name: str, text: str, overwrite: bool = False, sync: bool = False) -> bool:
        """False if the file is there and may not be overwritten. sync: the bytes are on disk when this returns."""
        try:
            out = self._fs.create(self._path(name), overwrite)
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise IoError(f"cannot write {self.path(name)}") from e
        out.write(bytearray(text.encode()))
        if sync:
            out.hsync()
        out.close()
        return True

    def write_new(self, name: str, text: str) -> bool:
        """False if the file is there. Of several writers one succeeds; a plain local file appears with all its text."""
        if not self._plain:
            return self.write(name, text)
        local, aside = self._local(name), f"{self._local(name)}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(aside, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(aside, local)
        except FileExistsError:
            return False
        finally:
            os.remove(aside)
        return True

    def age(self, name: str) -> float:
        """Seconds since the file was last written, by this machine's clock; 0 if it is not there."""
        try:
            return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Py4JJavaError:
            return 0.0

    def replace(self, name: str, text: str, sync: bool = False) -> None:
        """Readers see the old text or the new one."""
        if self._plain:  # Hadoop removes a local file before it renames another over it; between the two it would be missing
            aside = f"{name}.{uuid.uuid4().hex}.tmp"
            self.write(aside, text, sync=sync)
            os.replace(self._local(aside), self._local(name))
            return
        self.write(f"{name}.tmp", text, overwrite=True, sync=sync)
        jvm = self._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = option
        context.rename(self._path(f"{name}.tmp"), self._path(name), array)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise IoError(f"cannot rename {self.path(old)}")

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def take(self, old: str, new: str) -> bool:
        """Renames; False if another was faster. Of several takers of a file one succeeds."""
        if self._plain:
            try:
                os.rename(self._local(old), self._local(new))
            except FileNotFoundError:
                return False
            return True
        try:
            return bool(self._fs.rename(self._path(old), self._path(new)))
        except Py4JJavaError as e:  # some file systems raise where others return false
            if "FileNotFoundException" in e.java_exception.toString() or not self.exists(old):
                return False
            raise IoError(f"cannot rename {self.path(old)}") from e
