"""A folder of growing log files as a stream whose intake is capped in lines.

The cap is a token bucket: ``burst`` lines at once, ``rate`` lines a second over time.  On the driver the bucket only decides how
far the next micro-batch reaches, by counting line ends in what the files have beyond the last one, so it passes at most
``burst`` lines a trigger; the lines themselves are read by the tasks, one byte range a file.  Several streams over several
folders share nothing, as log shippers of several hosts do not.

Several streams over one folder (options ``streams`` and ``stream``) divide its files, so that one of them reads while another plans or
commits.  They run in one driver and take their lines from one bucket, a file of its machine (``bucket``): together they pass no more than one
stream would.  Which stream a file belongs to is kept in ``owners``, a file on shared storage beside their checkpoints; a new file goes to
the stream with the fewest bytes.  A file is read by one stream only, in order.

Offsets are bytes read per file.  The engine keeps them in the query's checkpoint; as it does not tell a restarted reader where it
stood, the end of every planned batch is also written to ``position``, a file on shared storage that belongs to the checkpoint.
A line counts once its line feed is there.  A file that became shorter is read from its start; one that is gone is forgotten.
"""

from __future__ import annotations

import contextlib
import fcntl
import fnmatch
import json
import re
import time

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sagebrush import config as C

BLOCK = 1 << 20  # bytes looked through at a time
LEAST_WAIT = 0.1  # seconds' worth of lines that a trigger waits for where more lines are there than it may take


def _open(uri: str):
    """(filesystem, path) of a path or address of shared storage."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class ByteRange(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class _ThrottledReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.position = options["path"], options["position"]
        self.glob = options.get("glob", "*")
        self.rate = float(options.get("linesPerSecond", C.LOG_RATE_LINES_PER_S))
        self.burst = float(options.get("burst", C.LOG_BURST_LINES))
        if self.rate <= 0 or self.burst < 1:
            raise ValueError("linesPerSecond must be above 0 and burst at least 1")
        self.stream, self.streams = int(options.get("stream", 0)), int(options.get("streams", 1))
        self.owners, self.bucket = options.get("owners"), options.get("bucket")
        if not 0 <= self.stream < self.streams or self.streams > 1 and not (self.owners and self.bucket):
            raise ValueError("several streams have a number below their count, a file of owners and a bucket")
        self.at: dict | None = None
        self.tokens, self.filled = self.burst, time.monotonic()

    # --- the driver's side

    def initialOffset(self) -> dict:
        return {}

    def _stored(self, uri: str) -> dict:
        system, path = _open(uri)
        if not system.get_file_info(path).is_file:
            return {}
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, path = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(path))
        return sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)
                      and not f.base_name.startswith((".", "_")))

    @contextlib.contextmanager
    def _shared(self):
        """The bucket of all streams, which the others wait for meanwhile."""
        if not self.bucket:
            yield
            return
        with open(self.bucket, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            if text := f.read():
                self.tokens, self.filled = json.loads(text)
            yield
            f.truncate(0)
            f.write(json.dumps([self.tokens, self.filled]))

    def _own_files(self) -> list[tuple[str, int]]:
        files = self._files()
        if not self.owners:
            return files
        owners = self._stored(self.owners)
        if owners.keys() != {name for name, _ in files}:
            with self._shared():    # what another stream settled meanwhile holds
                files, known = self._files(), self._stored(self.owners)
                owners = self._settled(files, known)
                system, path = _open(self.owners)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{path}.new") as f:
                    f.write(json.dumps(owners).encode())
                system.move(f"{path}.new", path)
        if any(owner >= self.streams for owner, _ in owners.values()):
            raise ValueError(f"files in {self.owners} belong to a stream beyond the {self.streams} of this run")
        return [x for x in files if owners[x[0]][0] == self.stream]

    def _settled(self, files: list[tuple[str, int]], known: dict) -> dict:
        """Stream and first size of every file: files stay where they are, new ones go to the stream with the fewest bytes."""
        owners, load = {name: known[name] for name, _ in files if name in known}, dict.fromkeys(range(self.streams), 0)
        for owner, size in owners.values():
            load[owner] = load.get(owner, 0) + size + 1     # files that are still empty are dealt out too
        for name, size in sorted(files, key=lambda x: -x[1]):
            if name not in owners:
                owner = min(range(self.streams), key=load.get)
                owners[name] = owner, size
                load[owner] += size + 1
        return owners

    def _forward(self, name: str, start: int, size: int, room: int) -> tuple[int, int]:
        """The place behind at most ``room`` line ends after ``start``, and how many they are."""
        system, _ = _open(self.folder)
        end, n = start, 0
        with system.open_input_file(name) as f:
            while n < room and start < size:
                block = f.read_at(min(BLOCK, size - start), start)
                here = block.count(b"\n")
                if n + here <= room:
                    n += here
                    end = start + block.rfind(b"\n") + 1 if here else end
                else:
                    cut = -1
                    for _ in range(room - n):
                        cut = block.find(b"\n", cut + 1)
                    n, end = room, start + cut + 1
                start += len(block)
        return end, n

    def _reach(self, files: list[tuple[str, int]], room: int) -> tuple[dict, int]:
        """How far at most ``room`` lines reach, and how many there are."""
        at, left = {}, room
        for name, size in files:
            start = self.at.get(name, 0)
            at[name], n = self._forward(name, 0 if start > size else start, size, left)
            left -= n
        return at, room - left

    def _refill(self) -> None:
        now = time.monotonic()
        self.tokens = min(self.burst, self.tokens + (now - self.filled) * self.rate)
        self.filled = now

    def _take(self, wanted: int) -> int:
        """As many of the wanted lines as may pass now, at least one."""
        with self._shared():
            self._refill()
            least = max(1.0, min(self.burst, self.rate * LEAST_WAIT, wanted))
            if self.tokens < least:
                time.sleep((least - self.tokens) / self.rate)
                self._refill()
                self.tokens = max(self.tokens, 1.0)  # a clock's rounding must not leave a trigger empty
            taken = min(wanted, int(self.tokens))
            self.tokens -= taken
        return taken

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._stored(self.position)
        files = self._own_files()
        at, wanted = self._reach(files, int(self.burst))
        if wanted and (taken := self._take(wanted)) < wanted:
            at, _ = self._reach(files, taken)
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        if self.at is None:
            self.at = end
        system, path = _open(self.position)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(json.dumps(end).encode())
        ranges = [(name, start.get(name, 0), to) for name, to in end.items()]
        return [ByteRange(name, 0 if a > b else a, b) for name, a, b in ranges if a != b]

    # --- the tasks' side

    def read(self, partition: ByteRange):
        import pyarrow as pa

        system, _ = _open(self.folder)
        with system.open_input_file(partition.name) as f:
            data = f.read_at(partition.end - partition.start, partition.start)
        lines = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in data.split(b"\n")[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([partition.name] * len(lines), pa.string())],
                                         names=["line", "path"])


class ThrottledLines(DataSource):
    """``spark.readStream.format("throttled_lines")`` with options path, position, glob, linesPerSecond and burst; of
    several streams over one folder also stream, streams, owners and bucket."""

    @classmethod
    def name(cls) -> str:
        return "throttled_lines"

    def schema(self) -> str:
        return "line string, path string"

    def streamReader(self, schema) -> _ThrottledReader:
        return _ThrottledReader(self.options)
