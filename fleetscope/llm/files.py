"""Files written and read by tasks in the cluster's shared folder, through Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import re
import uuid


def filesystem(uri: str):
    """(file system, path) of a folder or file; ``file:/x``, ``file:///x`` and plain paths are local."""
    from pyarrow import fs

    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


class committed:
    """Write under a name of its own, then move into place: a retried or doubled task leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.temp)
        return self.stream

    def __exit__(self, kind, value, trace):
        self.stream.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


def open_readable(uri: str):
    """A readable Arrow file; local ones are memory-mapped, so their batches are views."""
    import pyarrow as pa
    from pyarrow import fs

    where, path = filesystem(uri)
    return pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
