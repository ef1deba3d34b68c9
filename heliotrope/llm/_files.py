"""Files that Python workers write and read in a folder shared by driver and executors (local, S3, GCS or HDFS URIs)."""

from __future__ import annotations

import os


def filesystem(uri: str):
    """The pyarrow filesystem of a URI and its path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt() -> str:
    """A name of this attempt of the task, so that two attempts never share a temporary file."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.partitionId()}-{c.taskAttemptId()}" if c else f"0-{os.getpid()}"


class Committed:
    """A file written under a temporary name and moved to its own on close; a repeated task replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path = name, f"{base}/{name}"
        self.temporary = f"{base}/_{attempt()}-{name}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


def opened(folder: str, name: str):
    fs, base = filesystem(folder)
    return fs.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
