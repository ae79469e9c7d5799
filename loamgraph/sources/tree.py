"""A source tree as a table, by the Python data source API, on any file system that pyarrow knows (a path, or an address such
as hdfs:// or s3://).

Spark's own file listing leaves out names that begin with _ or . (an __init__.py among them), so the folders are listed
here: the driver lists the upper folders only, until there are `partitions` of them, each task lists and reads what is below
its own. Options: path; prune ("true" leaves out the skipped folders), extensions (comma-separated), partitions. Texts that aren't UTF-8
are left out, line ends become \\n. `ord` is unique and rises with the path."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamgraph.functions.names import SCANNED, SKIPPED_FOLDERS

SCHEMA = "path string, rel_path string, ext string, content string, ord long"
PARTITIONS = 64
ORDERS = 1 << 40  # numbers of a partition


class _Part(InputPartition):
    """Files by name, or a folder with all below it."""

    def __init__(self, number: int, files: list[str], folder: str | None) -> None:
        self.number, self.files, self.folder = number, files, folder


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:  # noqa: ANN001
        self.root = options["path"].rstrip("/")
        self.prune = str(options.get("prune", "true")).lower() == "true"
        self.extensions = tuple(options.get("extensions", ",".join(SCANNED)).split(","))
        self.most = int(options.get("partitions", PARTITIONS))

    def _system(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def _list(self, system, base: str, rel: str) -> tuple[list[str], list[str]]:  # noqa: ANN001
        """(folders, files) directly below a folder, by path below the root, that are wanted."""
        from pyarrow import fs

        folders, files = [], []
        for x in system.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
            name = f"{rel}/{x.base_name}" if rel else x.base_name
            if x.type == fs.FileType.Directory:
                if not (self.prune and x.base_name in SKIPPED_FOLDERS):
                    folders.append(name)
            elif os.path.splitext(x.base_name)[1] in self.extensions:
                files.append(name)
        return folders, files

    def partitions(self) -> list[InputPartition]:
        system, base = self._system()
        folders, files = [""], []
        while folders and len(folders) < self.most:
            below = []
            for f in folders:
                more, own = self._list(system, base, f)
                below += more
                files += own
            folders = below
        runs: list[tuple[list[str], str | None]] = []
        for path in sorted([*(f + "/" for f in folders), *files]):  # the order of full paths
            if path.endswith("/"):
                runs.append(([], path[:-1]))
            elif runs and runs[-1][1] is None:
                runs[-1][0].append(path)
            else:
                runs.append(([path], None))
        return [_Part(i, x, f) for i, (x, f) in enumerate(runs)] or [_Part(0, [], None)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, base = self._system()
        names, todo = list(partition.files), [] if partition.folder is None else [partition.folder]
        while todo:
            more, own = self._list(system, base, todo.pop())
            todo += more
            names += own
        for i, rel in enumerate(sorted(names)):
            try:
                with system.open_input_stream(f"{base}/{rel}") as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            yield f"{self.root}/{rel}", rel, os.path.splitext(rel)[1], text.replace("\r\n", "\n").replace("\r", "\n"), partition.number * ORDERS + i


def read_tree(spark, path: str, prune: bool = True, partitions: int = PARTITIONS):  # noqa: ANN001
    """A source tree as (path, rel_path, ext, content, ord)."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", path).option("prune", str(prune).lower()).option("partitions", str(partitions)).load()
