"""Files as files: shared scratch folders, whole small files with temporary names, reads at a place.

Everything goes through the store that Spark uses, so paths may be of any kind it knows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``; in local mode, where that is unset, in a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='marlpit-')}")
        root = _OWN[0]
    return f"{root.rstrip('/')}/marlpit-core/{tag}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _store(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to where nothing is, or in place of a file."""
    fs, p = _store(spark, source)
    _, to = _store(spark, target)
    if fs.exists(to) and not fs.getFileStatus(to).isDirectory():
        fs.delete(to, False)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"can't move {source} to {target}")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A whole file, under a temporary name until it is complete."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs, p = _store(spark, part)
    out = fs.create(p)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    rename(spark, part, path)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A copy of a file, under a temporary name until it is complete."""
    part = f"{target}.{uuid.uuid4().hex}.part"
    fs, p = _store(spark, source)
    other, to = _store(spark, part)
    other.mkdirs(to.getParent())
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    if not util.copy(fs, p, other, to, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"can't copy {source}")
    rename(spark, part, target)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Places:
    """An open file that is read at places; spans that lie at most ``gap`` bytes apart are one read."""

    def __init__(self, spark: SparkSession, path: str, gap: int = 4096) -> None:
        self.fs, self.path = _store(spark, path)
        self.stream, self.gap, self.reads = self.fs.open(self.path), gap, 0
        self.take = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
        self.size = self.fs.getFileStatus(self.path).getLen()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("the file ends before that")
        self.reads += 1
        self.stream.seek(at)
        return bytes(self.take(self.stream, n)) if n else b""

    def spans(self, wanted: list[tuple[int, int]]) -> list[bytes]:
        """The bytes of each ``(place, length)``, in the order asked for."""
        out: list[bytes] = [b""] * len(wanted)
        group: list[int] = []

        def fetch() -> None:
            lo, hi = wanted[group[0]][0], max(wanted[i][0] + wanted[i][1] for i in group)
            held = self.read(lo, hi - lo)
            for i in group:
                out[i] = held[wanted[i][0] - lo : wanted[i][0] - lo + wanted[i][1]]
            group.clear()

        end = 0
        for i in sorted(range(len(wanted)), key=lambda i: wanted[i]):
            if group and wanted[i][0] > end + self.gap:
                fetch()
            group.append(i)
            end = max(end if len(group) > 1 else 0, wanted[i][0] + wanted[i][1])
        if group:
            fetch()
        return out

    def close(self) -> None:
        self.stream.close()
