"""Files of a folder, listed by the executors and read no further than asked.

Spark's own file sources list on the driver, skip empty files and read files as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shares that the entries of a folder are dealt to, and rows of a batch.
SHARES = 256
BATCH_ROWS = 4096
#: Bytes of whole files that one batch holds before it is handed on.
BATCH_BYTES = 32 << 20


def open_root(root: str) -> tuple[fs.FileSystem, str, str]:
    """File system, its own path of ``root`` and what stands before such a path in a URI.

    Paths are plain, as Spark takes them, not percent-encoded.
    """
    if root.startswith(("/", "file:")):
        path = "/" + root.removeprefix("file:").strip("/")
        return fs.LocalFileSystem(), path, "file://"
    system, path = fs.FileSystem.from_uri(quote(root, safe=":/?#[]@!$&'()*+,;=%~"))
    path, plain = path.rstrip("/"), root.split("?")[0].rstrip("/")
    return system, path, plain[: len(plain) - len(path)]


class Share(InputPartition):
    """Some of the root's entries: (path, size), size -1 for a folder."""

    def __init__(self, entries: list[tuple[str, int]]):
        super().__init__(0)
        self.entries = entries


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        system, path, _ = open_root(self.root)
        found = sorted(
            (i.path, -1 if i.type == fs.FileType.Directory else i.size) for i in system.get_file_info(fs.FileSelector(path))
        )
        return [Share(found[k::SHARES]) for k in range(min(SHARES, len(found)))] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _, before = open_root(self.root)
        waiting, paths, sizes = list(partition.entries), [], []
        names = ["path", "size_bytes"]
        while waiting:
            path, size = waiting.pop()
            if size < 0:
                waiting += [
                    (i.path, -1 if i.type == fs.FileType.Directory else i.size) for i in system.get_file_info(fs.FileSelector(path))
                ]
                continue
            paths.append(before + path)
            sizes.append(size)
            if len(paths) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], names)
                paths, sizes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names)


class FolderFiles(DataSource):
    """All files below a folder, empty and hidden ones too: ``path, size_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, size_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes`` of every file below ``root``.

    The driver lists the root itself; its folders are walked by tasks, one folder level in
    memory at a time.
    """
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").load(root)


def with_bytes(files: DataFrame, root: str, most: int | None) -> DataFrame:
    """``files`` of ``list_files(root)`` with ``content``: their first ``most`` bytes, or all.

    Paths are dealt out again first, so that the files of one large folder are read by many
    tasks. A file that is gone by then is an error, which a new run settles.
    """
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, before = open_root(root)
        rows, held = [], 0
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["size_bytes"].to_pylist(), strict=True):
                with system.open_input_file(path[len(before):]) as file:
                    rows.append((path, size, file.read(most)))
                held += len(rows[-1][2])
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spread = files.select("path", "size_bytes").repartition(F.xxhash64("path"))
    return spread.mapInArrow(read, "path string, size_bytes long, content binary")
