"""Small files of a table on any file system that Spark can reach, and the folder that driver and executors share.

Local paths use the operating system, so that an append is durable when it returns and a file appears whole; others
use Hadoop's file systems, where streams are flushed with hsync and a rename does not replace a file.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and Spark runs in this process alone, as in tests, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", ""):
        return found
    if (found := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class LocalLog:
    """A file that is only appended to."""

    def __init__(self, path: str):
        self._file = open(path, "xb")

    def append(self, data: bytes) -> None:
        self._file.write(data)
        self._file.flush()
        os.fsync(self._file.fileno())

    def close(self) -> None:
        self._file.close()


class HadoopLog:
    def __init__(self, stream):
        self._stream = stream

    def append(self, data: bytes) -> None:
        self._stream.write(bytearray(data))
        self._stream.hsync()

    def close(self) -> None:
        self._stream.close()


class LocalFiles:
    def __init__(self, root: str):
        self.root = root

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self, name: str) -> None:
        os.makedirs(self._at(name), exist_ok=True)

    def names(self, name: str) -> list[str]:
        return sorted(os.listdir(self._at(name))) if os.path.isdir(self._at(name)) else []

    def exists(self, name: str) -> bool:
        return os.path.exists(self._at(name))

    def read(self, name: str) -> bytes:
        with open(self._at(name), "rb") as file:
            return file.read()

    def create(self, name: str, data: bytes) -> None:
        """The file, whole and durable; FileExistsError if it is there."""
        tmp = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        with open(tmp, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(tmp, self._at(name))
        finally:
            os.unlink(tmp)

    def log(self, name: str) -> LocalLog:
        return LocalLog(self._at(name))

    def delete(self, name: str) -> None:
        if os.path.isdir(self._at(name)):
            shutil.rmtree(self._at(name), ignore_errors=True)
        elif os.path.exists(self._at(name)):
            os.unlink(self._at(name))

    def copy(self, name: str, target: str) -> None:
        """The file or folder under another path; files are linked where that is possible, as none is ever changed."""
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.isdir(self._at(name)):
            shutil.copytree(self._at(name), target, copy_function=_link)
        else:
            shutil.copy(self._at(name), target)


def _link(source: str, target: str) -> None:
    try:
        os.link(source, target)
    except OSError:
        shutil.copy(source, target)


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm, self._conf = root, spark._jvm, spark._jsc.hadoopConfiguration()
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(root).getFileSystem(self._conf)
        if self._fs.getScheme() == "file":  # the one with checksums keeps what is not a whole block of them
            self._fs = self._fs.getRawFileSystem()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        from py4j.protocol import Py4JJavaError

        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        log = self.log(tmp)
        log.append(data)
        log.close()
        context = self._hadoop.FileContext.getFileContext(self._at(name).toUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(self._at(tmp)), context.makeQualified(self._at(name)), none)
        except Py4JJavaError as failed:
            self._fs.delete(self._at(tmp), False)
            if "FileAlreadyExistsException" in str(failed.java_exception):
                raise FileExistsError(name) from None
            raise

    def log(self, name: str) -> HadoopLog:
        return HadoopLog(self._fs.create(self._at(name), False))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def copy(self, name: str, target: str) -> None:
        to = self._hadoop.Path(target)
        self._hadoop.FileUtil.copy(self._fs, self._at(name), to.getFileSystem(self._conf), to, False, self._conf)


def files(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    """Of a folder. A path without a scheme is local if it begins with / and Spark's default file system is."""
    if "://" not in root and not root.startswith("file:"):
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return LocalFiles(root) if default.startswith("file:") else HadoopFiles(spark, root)
    return HadoopFiles(spark, root)
