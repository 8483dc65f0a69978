"""Files that tasks write and read in the shared folder, by any store that pyarrow opens."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A store and the path in it; plain paths are local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def read_table(uri: str) -> pa.Table:
    """One Parquet file of a table that the engine wrote itself."""
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return pq.read_table(f)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name of one task attempt. Only the names that successful attempts return enter a
    manifest, so the leavings of a lost or repeated attempt are never read."""
    import uuid

    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{prefix}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{suffix}"


class RangeReader:
    """Ranges of files, with a few files kept open."""

    def __init__(self, most: int = 16):
        self.most, self.open_files, self.store = most, OrderedDict(), {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        handle = self.open_files.pop(uri, None)
        if handle is None:
            store, path = open_store(uri)
            handle = store.open_input_file(path)
            while len(self.open_files) >= self.most:
                self.open_files.popitem(last=False)[1].close()
        self.open_files[uri] = handle
        return handle.read_at(length, offset)

    def size(self, uri: str) -> int:
        self.read(uri, 0, 0)
        return self.open_files[uri].size()

    def close(self) -> None:
        while self.open_files:
            self.open_files.popitem()[1].close()
