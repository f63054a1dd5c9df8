"""Parts of files: image headers by their first bytes, and members of zip archives by ranges of their directory.

Files are opened where the work is done, by path or by a URI of a store that Arrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import ship_package
from plumbline.sources.headers import image_header

#: Bytes of a file that tell its header, and compressed bytes of the members that one task reads.
HEAD_BYTES, RANGE_BYTES = 16_384, 64 << 20
HEADER = "path string, width bigint, height bigint, file_format string, pil_mode string, file_bytes bigint, read_bytes bigint"
MEMBER = "archive string, member string, content binary"


class _Remote(io.RawIOBase):
    """A file of a store as a plain one: places before its begin are errors."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.length = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        at += (0, self.file.tell() if whence == 1 else 0, self.length)[whence]
        if at < 0:
            raise OSError("place before the file's begin")
        self.file.seek(at)
        return at

    def readinto(self, into: memoryview) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str, buffered: bool = True) -> io.IOBase:
    """A file for reading at any place; plain paths are local ones. Without a buffer no more is read than is asked for."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb", buffering=-1 if buffered else 0)
    store, inside = fs.FileSystem.from_uri(path)
    raw = _Remote(store.open_input_file(inside))
    return io.BufferedReader(raw) if buffered else raw


def jpeg_frame(read: Callable[[int, int], bytes]) -> tuple[int, int, str, str]:
    """Header of a JPEG whose frame lies behind long metadata: from segment to segment, ten bytes at each.
    ``read(at, n)`` gives up to n bytes from a place on."""
    at = 2
    while len(b := read(at, 10)) == 10 and b[0] == 0xFF:
        if b[1] == 0xFF:
            at += 1
            continue
        # The parser sees this segment as if it were the first.
        found = image_header(b"\xff\xd8" + b + b"\0")
        if found[0]:
            return found
        at += 2 + struct.unpack(">H", b[2:4])[0]
    return image_header(b"")


def header(path: str) -> tuple[tuple[int, int, str, str], int]:
    """Header of an image and the bytes that were read for it: HEAD_BYTES at most, but for JPEG whose frame lies further on."""
    with opened(path, buffered=False) as f:
        total = 0

        def read(at: int, n: int) -> bytes:
            nonlocal total
            f.seek(at)
            got = f.read(n)
            total += len(got)
            return got
        head = read(0, HEAD_BYTES)
        found = image_header(head)
        if not (found[0] > 0 and found[1] > 0) and head[:2] == b"\xff\xd8" and len(head) == HEAD_BYTES:
            found = jpeg_frame(read)
        return found, total


def headers(files: DataFrame) -> DataFrame:
    """HEADER of every row of ``files(path, length)``; width and height 0 where no header is understood or the file can't be opened."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    found, total = header(path)
                except OSError:
                    found, total = image_header(b""), 0
                out.append((path, *found, length, total))
            names = [c.split()[0] for c in HEADER.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in HEADER.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
    return files.select("path", "length").mapInArrow(run, HEADER)


class Members(InputPartition):
    """Members ``first`` to ``last`` (exclusive) of an archive, in the order of its directory."""

    def __init__(self, archive: str, first: int, last: int) -> None:
        self.archive, self.first, self.last = archive, first, last


class ZipReader(DataSourceReader):
    def __init__(self, path: str, ending: tuple[str, ...], range_bytes: int) -> None:
        self.path, self.ending, self.range_bytes = path, ending, range_bytes

    def _archives(self) -> list[str]:
        """The archive itself, or all archives below a folder."""
        store, inside = (fs.LocalFileSystem(), self.path) if "://" not in self.path and not self.path.startswith("file:") else fs.FileSystem.from_uri(self.path)
        front = self.path[: len(self.path) - len(inside)] if self.path.endswith(inside) else ""
        if store.get_file_info(inside).type == fs.FileType.Directory:
            return sorted(front + f.path for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.is_file and f.path.lower().endswith(".zip"))
        return [self.path]

    def _wanted(self, z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [m for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(self.ending)]

    def partitions(self) -> list[Members]:
        """Reads the directories, not the members, and keeps the limits of the ranges only."""
        out = []
        for archive in self._archives():
            with opened(archive) as f, zipfile.ZipFile(f) as z:
                first, size, at = 0, 0, 0
                for at, m in enumerate(self._wanted(z)):
                    if size and size + m.compress_size > self.range_bytes:
                        out.append(Members(archive, first, at))
                        first, size = at, 0
                    size += m.compress_size + 64  # an entry's own header
                if size:
                    out.append(Members(archive, first, at + 1))
        return out or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        with opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            for m in self._wanted(z)[partition.first : partition.last]:
                yield partition.archive, m.filename, z.read(m)


class ZipSource(DataSource):
    """Spark source ``zip_members``: (archive, member, content) of an archive or of all below a folder. Options: path, endings (comma-separated
    suffixes, all members without), range_bytes. A task holds one member at a time and reads the bytes of its range only."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: object) -> ZipReader:
        o = self.options
        return ZipReader(o["path"], tuple(x.strip().lower() for x in o.get("endings", "").split(",")), int(o.get("range_bytes", RANGE_BYTES)))


def zip_members(spark: SparkSession, path: str, endings: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Members of a zip archive, or of all archives below a folder, as the source ``zip_members`` reads them."""
    ship_package(spark)
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").option("endings", ",".join(endings)).option("range_bytes", range_bytes).load(path)
