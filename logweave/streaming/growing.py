"""Growing log files as a streaming source: each batch holds what was appended since the last, to the last line feed."""

from __future__ import annotations

import bz2
import glob
import gzip
import hashlib
import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Files of these endings are read whole once; the others cannot be read here.
PACKED = {".gz": gzip.open, ".bz2": bz2.open}
UNREADABLE = (".zst", ".lz4", ".snappy", ".deflate")
BLOCK = 8 << 20
HEAD = 1024


def listed(folder: str) -> list[str]:
    """Files of a folder (and its ``key=value`` folders), of a glob or of a path; hidden ones left out."""
    found: list[str] = []
    for top in [folder] if os.path.exists(folder) else glob.glob(folder):
        if not os.path.isdir(top):
            found.append(top)
            continue
        for e in os.scandir(top):
            if e.is_file() and not e.name.startswith((".", "_")):
                found.append(e.path)
            elif e.is_dir() and "=" in e.name:
                found += listed(e.path)
    return sorted(found)


def last_line_feed(path: str, end: int | None = None) -> int:
    """The byte behind the last line feed of a file, looked for from its end (or from ``end``) backward; 0 if there is none."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END) if end is None else end
        while at > 0:
            lo = max(0, at - 65536)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return 0


def last_boot(path: str, boot: str, head: str, block: int = 65536, align: int = 4096) -> int | None:
    """The byte at which the last restart of a file begins: looked for from the end in blocks, so a long file is hardly read.

    boot: any message of a restart; head: those that come first.  The last
    message of the file counts, with the earliest head message at most
    ``align`` bytes before; the start of its line is given, None without any.
    """
    any_, first = re.compile(boot.encode()), re.compile(head.encode())
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        found = None
        while end > 0 and found is None:
            lo = max(0, end - block)
            f.seek(lo)
            hits = list(any_.finditer(f.read(end - lo + 256)))  # a message may go over the end of the block
            found = lo + hits[-1].start() if hits else None
            end = lo
        if found is None:
            return None
        lo = max(0, found - align)
        f.seek(lo)
        heads = [lo + m.start() for m in first.finditer(f.read(found - lo + 256)) if lo + m.start() <= found]
        return last_line_feed(path, min(heads, default=found))


def position(path: str, settle_s: float) -> dict | None:
    """What is readable of a file: its inode, a digest of its first line, and the end of the last whole line.

    A last line without line feed is being written, unless the file was not
    changed for ``settle_s`` seconds.  None if nothing is readable yet.
    """
    with open(path, "rb") as f:
        st = os.fstat(f.fileno())
        end = st.st_size
        if os.path.splitext(path)[1] not in PACKED and time.time() - st.st_mtime < settle_s:
            end = last_line_feed(path, end)
        f.seek(0)
        head = f.read(min(HEAD, end)).split(b"\n", 1)[0]
    return {"inode": st.st_ino, "head": hashlib.md5(head).hexdigest(), "end": end} if end else None


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, settle_s: float):
        self.folder, self.settle_s = folder, settle_s

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in listed(self.folder):
            if path.endswith(UNREADABLE):
                raise ValueError(f"{path}: cannot be read as a growing file; give files_per_batch to read closed files")
            try:
                at = position(path, self.settle_s)
            except FileNotFoundError:  # rotated since it was listed
                continue
            if at:
                out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """A file is known by inode and first line, so a renamed one goes on where it was; one that was truncated or replaced begins anew."""
        known = {(x["inode"], x["head"]): x["end"] for x in start.values()}
        parts = []
        for path, x in end.items():
            done = known.get((x["inode"], x["head"]), 0)
            if os.path.splitext(path)[1] in PACKED:
                parts += [] if done else [Part(path, 0, x["end"])]
            elif done != x["end"]:
                parts.append(Part(path, done if done < x["end"] else 0, x["end"]))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        packed = PACKED.get(os.path.splitext(partition.path)[1])
        with (packed or open)(partition.path, "rb") as f:
            line, at = 1, 0
            while at < partition.start:
                if not (b := f.read(min(BLOCK, partition.start - at))):
                    break
                line, at = line + b.count(b"\n"), at + len(b)
            while packed or at < partition.end:
                b = f.read(BLOCK if packed else min(BLOCK, partition.end - at))
                if b and not b.endswith(b"\n") and (packed or at + len(b) < partition.end):
                    b += f.readline() if packed else f.readline(partition.end - at - len(b))
                if not b:
                    break
                yield pa.RecordBatch.from_pydict({"source": [partition.path], "first_line": pa.array([line], pa.int64()), "text": [b.decode("utf-8", "replace")]})
                line, at = line + b.count(b"\n"), at + len(b)


class GrowingFiles(DataSource):
    """(source, first_line, text): whole lines appended to the files of ``folder`` since the batch before.

    The offset of the stream, kept in its checkpoint, holds the end of each
    file.  Line numbers go on from the lines before, which are counted where
    the file is read.  A file is its inode and first line: after truncation
    or rotation the new one is read from its beginning.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "source string, first_line long, text string"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["folder"], float(self.options["settle_s"]))
