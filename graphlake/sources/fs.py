"""Files of any Hadoop file system: small texts, counts and renames, from the driver."""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from ..errors import InvalidError, StorageError
from ..session import ship

#: Files below a mounted folder from which tasks remove them, and that each removes, about.
MANY_FILES, FILES_A_TASK = 8_192, 2_048
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss", "wasb", "viewfs")


def _shares(root: str) -> list[list[tuple[str, int, int]]]:
    """For each task some (folder, k, n): a folder's files that fall to k of n by their names. None where files are few."""
    sizes = [(folder, len(files)) for folder, _, files in os.walk(root)]
    if sum(n for _, n in sizes) < MANY_FILES:
        return []
    out, room = [], 0
    for folder, size in sizes:
        n = max(1, -(-size // FILES_A_TASK))
        for k in range(n):
            if room < 1 + size // n:
                out.append([])
                room = FILES_A_TASK
            out[-1].append((folder, k, n))
            room -= 1 + size // n
    return out


def _remove(share: list[tuple[str, int, int]]) -> None:
    for folder, k, n in share:
        with contextlib.suppress(FileNotFoundError), os.scandir(folder) as found:
            for f in found:
                if not f.is_dir(follow_symlinks=False) and (n == 1 or zlib.crc32(f.name.encode()) % n == k):
                    with contextlib.suppress(FileNotFoundError):  # another attempt was faster
                        os.remove(f.path)
        if n == 1:
            with contextlib.suppress(OSError):  # others are below
                os.rmdir(folder)


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._default: str | None = None
        self._path = self.jvm.org.apache.hadoop.fs.Path  # looked up once: each name on the way is a call

    def check(self, uri: str) -> str:
        """A path or URI of a known scheme, as it is."""
        if urlparse(uri).scheme not in SCHEMES:
            raise InvalidError(f"no file system for {uri!r}")
        return uri

    def _at(self, path: str):
        p = self._path(self.check(path))
        return p, p.getFileSystem(self.conf)

    def mounted(self, path: str) -> str | None:
        """The path as the operating system has it, where it is on a file system that the machines have mounted.

        Small files are read and written there directly: Hadoop's own classes start a process for each.
        """
        uri = urlparse(self.check(path))
        if not uri.scheme:
            if self._default is None:
                self._default = str(self.conf.get("fs.defaultFS", "file:///"))
            return path if self._default.startswith("file:") and path.startswith("/") else None
        return uri.path if uri.scheme == "file" and not uri.netloc and not uri.query and not uri.fragment else None

    def exists(self, path: str) -> bool:
        if (own := self.mounted(path)) is not None:
            return os.path.exists(own)
        p, fs = self._at(path)
        return bool(fs.exists(p))

    def list(self, path: str) -> list[str]:
        """Names in a folder, sorted; none where it isn't there."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def below(self, path: str) -> list[str]:
        """Paths of all files below a folder, relative to it; none where it isn't there. Hidden files don't count."""
        if (own := self.mounted(path.rstrip("/"))) is not None:  # Hadoop starts a process for each file's permissions
            there = (os.path.relpath(os.path.join(at, f), own) for at, _, names in os.walk(own) for f in names)
            return sorted(f for f in there if not f.rsplit("/", 1)[-1].startswith((".", "_")))
        p, fs = self._at(path.rstrip("/"))
        if not fs.exists(p):
            return []
        root, found = str(fs.makeQualified(p).toString()), []
        files = fs.listFiles(p, True)
        while files.hasNext():
            found.append(str(files.next().getPath().toString())[len(root) + 1 :])
        return sorted(f for f in found if not f.rsplit("/", 1)[-1].startswith((".", "_")))

    def delete(self, path: str) -> None:
        if (own := self.mounted(path)) is not None and os.path.isdir(own) and not os.path.islink(own):
            if shares := _shares(own):
                ship(self.spark)
                with contextlib.suppress(Exception):  # what tasks leave, or don't see, goes after this
                    self.spark.sparkContext.parallelize(shares, len(shares)).foreach(_remove)
            shutil.rmtree(own)
            return
        p, fs = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """Renames over what is there, and makes folders as needed.

        Files of mounted folders without Hadoop, which takes some ten calls for each; its sums of files go along.
        """
        own, to = self.mounted(source), self.mounted(target)
        if own is not None and to is not None and os.path.isfile(own) and not os.path.isdir(to):
            (folder, base), (at, name) = os.path.split(own), os.path.split(to)
            os.makedirs(at, exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # the sum of what was there
                os.remove(f"{at}/.{name}.crc")
            with contextlib.suppress(FileNotFoundError):
                os.replace(f"{folder}/.{base}.crc", f"{at}/.{name}.crc")
            os.replace(own, to)
            return
        p, fs = self._at(source)
        q = self._at(target)[0]
        fs.mkdirs(q.getParent())
        fs.delete(q, True)
        if not fs.rename(p, q):
            raise StorageError(f"can't rename {source} to {target}")

    def rename_all(self, moves: list[tuple[str, str]], at_once: int = 16) -> None:
        """Renames files to places where nothing is yet, some at a time."""
        for parent in {to.rsplit("/", 1)[0] for _, to in moves}:
            p, fs = self._at(parent)
            fs.mkdirs(p)

        fs = self._at(moves[0][0])[1] if moves else None

        def rename(move: tuple[str, str]) -> None:
            if not fs.rename(self._path(move[0]), self._path(move[1])):
                raise StorageError(f"can't rename {move[0]} to {move[1]}")

        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(rename, moves))

    def glob(self, pattern: str) -> list[str]:
        """Paths that match, in one listing; none where nothing does."""
        p, fs = self._at(pattern)
        return [str(s.getPath().toString()) for s in fs.globStatus(p) or []]

    def replace(self, source: str, target: str) -> None:
        """A folder takes the place of another, which goes last; if there is no source, the target only goes."""
        q, fs = self._at(target.rstrip("/"))
        old = self._at(f"{target.rstrip('/')}-old-{uuid.uuid4().hex}")[0]
        had = bool(fs.exists(q))
        if had and not fs.rename(q, old):
            raise StorageError(f"can't move {target} away")
        if self.exists(source):
            p = self._at(source)[0]
            fs.mkdirs(q.getParent())
            if not fs.rename(p, q):
                if had:
                    fs.rename(old, q)
                raise StorageError(f"can't rename {source} to {target}")
        if had:
            fs.delete(old, True)

    def copy(self, source: str, target: str) -> None:
        p, fs = self._at(source)
        q, other = self._at(target)
        other.mkdirs(q.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, True, self.conf)

    def read_bytes(self, path: str) -> bytes:
        if (own := self.mounted(path)) is not None:
            try:
                with open(own, "rb") as f:
                    return f.read()
            except (FileNotFoundError, NotADirectoryError):
                raise StorageError(f"no file {path}") from None
        p, fs = self._at(path)
        if not fs.exists(p):
            raise StorageError(f"no file {path}")
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes) -> None:
        if (own := self.mounted(path)) is not None:
            folder, base = os.path.split(own)
            os.makedirs(folder, exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # the sum of what Hadoop wrote there before
                os.remove(f"{folder}/.{base}.crc")
            with open(own, "wb") as f:
                f.write(data)
            return
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")

    def write_text(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode("utf-8"))

    def read_count(self, path: str) -> int:
        """A long in eight bytes, lowest first."""
        data = self.read_bytes(path)
        if len(data) != 8:
            raise StorageError(f"{path} holds {len(data)} bytes, not a count")
        return struct.unpack("<q", data)[0]

    def write_count(self, path: str, n: int) -> None:
        self.write_bytes(path, struct.pack("<q", n))

    def read_counts(self, paths: list[str]) -> list[int]:
        """A count from each path, 0 where no file is there; of mounted folders in one go, without a look at each path's kind."""
        if not paths or (own := self.mounted(paths[0])) is None:
            with ThreadPoolExecutor(16) as pool:
                return list(pool.map(lambda p: self.read_count(p) if self.exists(p) else 0, paths))
        before = len(paths[0]) - len(own)
        out = []
        for path in paths:
            try:
                with open(path[before:], "rb", buffering=0) as f:
                    data = f.read(9)
            except (FileNotFoundError, NotADirectoryError):
                data = bytes(8)
            if len(data) != 8:
                raise StorageError(f"{path} doesn't hold a count of eight bytes")
            out.append(struct.unpack("<q", data)[0])
        return out

    def write_counts(self, counts: list[tuple[str, int]]) -> None:
        """A count to each path; the paths of a mounted folder are written in one go."""
        if not counts or (own := self.mounted(counts[0][0])) is None:
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda c: self.write_count(*c), counts))
            return
        before, made = len(counts[0][0]) - len(own), {}
        for path, n in counts:
            folder, base = os.path.split(path[before:])
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made[folder] = set(os.listdir(folder))
            if f".{base}.crc" in made[folder]:  # the sum of what Hadoop wrote there before
                os.remove(f"{folder}/.{base}.crc")
            with open(f"{folder}/{base}", "wb", buffering=0) as f:
                f.write(struct.pack("<q", n))
