"""A Spark data source of folder trees: all names, hidden ones too, and folders that are left out are never entered.

Spark's own file readers pass over names with a leading dot or underscore. Here the driver lists only as many
levels as it takes to have work for all tasks; tasks walk the folders below, filter by name and size before
they open a file, and give contents in batches of bounded size. Folders may lie in any store that
pyarrow.fs opens by its URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PARTS = 256  # of work at least, where there are so many folders
LEVELS = 4  # that the driver lists at most
BATCH_BYTES = 64 << 20


@dataclass
class Walk(InputPartition):
    """Folders to walk, and folders whose own files alone are meant."""

    deep: tuple[str, ...]
    flat: tuple[str, ...]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.excluded = frozenset(json.loads(options.get("excluded", "[]")))
        self.exts = frozenset(json.loads(options.get("exts", "[]")))
        self.names = frozenset(json.loads(options.get("names", "[]")))
        self.most = int(options.get("maxbytes", 1 << 62))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def _list(self, store: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
        """(folders to enter, files) right below a folder."""
        below = store.get_file_info(fs.FileSelector(folder))
        return [x.path for x in below if x.type == fs.FileType.Directory and x.base_name not in self.excluded], [x for x in below if x.type == fs.FileType.File]

    def partitions(self) -> list[Walk]:
        store, root = self._open()
        flat, deep = [], [root.rstrip("/")]
        for _ in range(LEVELS):
            if not deep or len(deep) >= PARTS:
                break
            flat += deep
            deep = [d for f in deep for d in self._list(store, f)[0]]
        n = max(1, min(PARTS * 16, len(deep) + len(flat)))
        return [Walk(tuple(deep[i::n]), tuple(flat[i::n])) for i in range(n)]

    def _wanted(self, x: fs.FileInfo) -> bool:
        dot = x.base_name.rfind(".")
        return x.size <= self.most and (x.base_name in self.names or not self.exts or (x.base_name[dot:].lower() if dot > 0 else "") in self.exts)

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        store, root = self._open()
        start = len(root.rstrip("/")) + 1
        todo = [(f, True) for f in partition.deep] + [(f, False) for f in partition.flat]
        rows, held = [], 0
        while todo:
            folder, enter = todo.pop()
            folders, files = self._list(store, folder)
            todo += [(f, True) for f in folders] if enter else []
            for x in filter(self._wanted, files):
                with store.open_input_stream(x.path) as f:
                    content = f.read()
                rows.append((x.path[start:], x.size, content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["file_path", "length", "content"])


class Folders(DataSource):
    """``spark.read.format("folders").option("path", ...)``; lists as JSON: ``excluded`` folder names, ``exts``, ``names`` that count whatever their extension; ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "file_path string, length bigint, content binary"

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})
