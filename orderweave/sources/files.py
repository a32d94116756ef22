"""Files as streams whose offsets say what has been read, as Python data sources.

`FrameFiles` (format frame_files): the videos of a folder, or its images if it has no videos, in natural order of their names. `LineLogs`
(format line_logs): the lines of logs that grow, such as a feed of commands. Both reach any store that pyarrow's file
systems know, from the driver (names and sizes) and from executors (contents), and start again where a checkpoint left off.

    for source in (FrameFiles, LineLogs):
        spark.dataSource.register(source)
    spark.readStream.format("frame_files").option("path", folder).load()

A folder without files gives no rows. Files with other endings, and folders, aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Endings of files that are videos and images.
VIDEOS = (".mp4", ".avi", ".mov", ".mkv", ".m4v", ".wmv", ".flv")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def natural(name: str) -> list[tuple[int, int, str]]:
    """A key by which runs of digits are in order of their numbers, and letters of their lower case."""
    return [(0, int(part), "") if part.isdigit() else (1, 0, part.lower()) for part in re.findall(r"[0-9]+|[^0-9]+", name)] + [(2, 0, name)]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, folder = _opened(path)
    return store, [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]


def _frames(path: str, kind: str | None) -> tuple[str | None, list[fs.FileInfo]]:
    """Videos, or images if there are no videos, in order; kind: which of them it is already."""
    found = _listed(path)[1]
    by_kind = {k: sorted((f for f in found if f.base_name.lower().endswith(ends)), key=lambda f: natural(f.base_name)) for k, ends in (("video", VIDEOS), ("image", IMAGES))}
    kind = kind or next((k for k, files in by_kind.items() if files), None)
    return kind, by_kind.get(kind, [])


class _Files(InputPartition):
    def __init__(self, path: str, kind: str, files: list[tuple[int, str, int]], content: bool):
        super().__init__(None)
        self.path, self.kind, self.files, self.content = path, kind, files, content


def _read_files(part: _Files) -> Iterator[tuple]:
    store, folder = _opened(part.path)
    for place, name, size in part.files:
        content = None
        if part.content:
            with store.open_input_file(f"{folder.rstrip('/')}/{name}") as f:
                content = f.read()
        yield place, part.kind, name, size, content


class FrameFiles(DataSource):
    """place (from 0), kind (video, image), name, size, content (with option content=true). Options: path, content, together (files of a partition),
    most (files of a batch). A file that comes later must come later in order too: one that would have to be read before what has been
    read fails the stream, rather than being lost."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "place long, kind string, name string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameStream(self.options)


class _FrameParts:
    def __init__(self, options):
        self.path, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.together, self.most = int(options.get("together", "64")), int(options.get("most", str(1 << 40)))

    def parts(self, kind: str, files: list[fs.FileInfo], first: int) -> list[_Files]:
        rows = [(first + k, f.base_name, f.size) for k, f in enumerate(files)]
        return [_Files(self.path, kind, rows[k : k + self.together], self.content) for k in range(0, len(rows), self.together)]


class _FrameReader(_FrameParts, DataSourceReader):
    def partitions(self):
        kind, files = _frames(self.path, None)
        return self.parts(kind or "", files, 0) or [_Files(self.path, "", [], False)]

    def read(self, partition):
        return _read_files(partition)


class _FrameStream(_FrameParts, DataSourceStreamReader):
    """An offset has how many files were read, the last one's name, and their kind."""

    def __init__(self, options):
        super().__init__(options)
        self.at: dict | None = None  # the last offset that this run knows

    def initialOffset(self) -> dict:
        return {"n": 0, "last": "", "kind": ""}

    def _since(self, start: dict) -> tuple[str, list[fs.FileInfo]]:
        kind, files = _frames(self.path, start["kind"] or None)
        before = [f for f in files if start["n"] and natural(f.base_name) <= natural(start["last"])]
        if len(before) > start["n"]:
            raise ValueError(f"{len(before) - start['n']} files of {self.path} have come whose names lie before {start['last']}, which was read already")
        return kind or "", files[len(before) :]

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        kind, files = self._since(start)
        files = files[: self.most]
        if files:
            self.at = {"n": start["n"] + len(files), "last": files[-1].base_name, "kind": kind}
        return self.at or start

    def partitions(self, start: dict, end: dict):
        self.at = max((o for o in (self.at, end) if o), key=lambda o: o["n"])  # after a restart the checkpoint's offset comes here first
        kind, files = self._since(start)
        return self.parts(kind, [f for f in files if natural(f.base_name) <= natural(end["last"])], start["n"]) if end["n"] > start["n"] else []

    def read(self, partition):
        return _read_files(partition)


class _Lines(InputPartition):
    def __init__(self, path: str, name: str, begin: int, end: int):
        super().__init__(None)
        self.path, self.name, self.begin, self.end = path, name, begin, end


class LineLogs(DataSource):
    """name, place (the byte at which a line begins), line of all logs of a folder. Options: path, piece (bytes of a partition), most (bytes of a log in a batch).
    Only lines that have ended count; a log that has become shorter fails the stream. An offset has a number for each log, so
    logs should be few, as with a feed for each site, and long."""

    @classmethod
    def name(cls) -> str:
        return "line_logs"

    def schema(self) -> str:
        return "name string, place long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options)


class _LineStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.piece, self.most = options["path"], int(options.get("piece", str(32 << 20))), int(options.get("most", str(1 << 50)))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, files = _listed(self.path)
        out = dict(self.at)
        for f in files:
            begin = self.at.get(f.base_name, 0)
            if f.size < begin:
                raise ValueError(f"{f.path} has lost lines that were read already")
            if f.size > begin and (end := self._line_end(store, f, begin)) > begin:
                out[f.base_name] = end
        self.at = out
        return out

    def _line_end(self, store: fs.FileSystem, f: fs.FileInfo, begin: int) -> int:
        """The end of the last whole line, or of the last that begins within `most` bytes."""
        stop = min(f.size, begin + self.most)
        with store.open_input_file(f.path) as log:
            at = stop
            while at > begin:  # backwards in blocks, to the last line's end before stop
                lo = max(begin, at - 65536)
                log.seek(lo)
                k = log.read(at - lo).rfind(b"\n")
                if k >= 0:
                    return lo + k + 1
                at = lo
            log.seek(stop)
            while stop < f.size:  # no line ends within `most`: the first that does later on
                block = log.read(65536)
                k = block.find(b"\n")
                if k >= 0:
                    return stop + k + 1
                stop += len(block)
        return begin

    def partitions(self, start: dict, end: dict):
        self.at = {k: max(self.at.get(k, 0), v) for k, v in {**self.at, **end}.items()}
        cuts = [(name, lo, min(lo + self.piece, stop)) for name, stop in sorted(end.items()) for lo in range(start.get(name, 0), stop, self.piece)]
        return [_Lines(self.path, *c) for c in cuts]

    def read(self, partition: _Lines) -> Iterator[tuple]:
        """Lines that begin within a piece; the last one may end beyond it."""
        store, folder = _opened(partition.path)
        with store.open_input_file(f"{folder.rstrip('/')}/{partition.name}") as log:
            at = partition.begin
            if at:  # a line begins here only if another one ends before
                log.seek(at - 1)
                skipped = _rest_of_line(log)
                at += len(skipped) - 1
            log.seek(at)
            while at < partition.end:
                line = _rest_of_line(log)
                if not line:
                    break
                yield partition.name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


def _rest_of_line(log) -> bytes:
    parts = []
    while True:
        here = log.tell()
        block = log.read(8192)
        k = block.find(b"\n")
        if k >= 0:
            parts.append(block[: k + 1])
            log.seek(here + k + 1)
            return b"".join(parts)
        parts.append(block)
        if not block:
            return b"".join(parts)
