"""All tables of a write in one transaction, without a database.

``published_files`` is a data source for writing.  Each task writes its rows to files of its own, one per store, below a
folder that no reader looks at.  When all tasks are done, the commit publishes their files by one small
manifest, which comes into its place by a rename; a failed write removes what its tasks have left, and readers never
see any of it.  Files of attempts that were repeated are in no manifest.

A write has a label.  A label written again takes the place of what it was, and a write may name labels that
it takes the place of.  One writer at a time publishes to a folder.

The folder is a path or a URI that ``pyarrow.fs`` opens on all machines (``file``, ``hdfs``, ``s3``).
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "published_files"
#: Column that names the store of a row.
STORE = "store"
#: Seconds after which files of a write that was never published are taken for left ones.
ORPHANS_AFTER = 86_400.0
#: How often an aborted write looks for files to remove, a tenth of a second apart.
ABORT_LOOKS = 20


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: store and path below the folder."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, label: str, replaces: list[str]):
        self.folder, self.label, self.replaces, self.run = folder, label, replaces, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.folder)
        part, open_files, files = uuid.uuid4().hex, {}, []
        try:
            for batch in iterator:
                names = batch.column(STORE)
                for store in pc.unique(names).to_pylist():
                    rows = pa.Table.from_batches([batch.filter(pc.equal(names, store))])
                    if store not in open_files:
                        path = f"data/{self.run}/{store}/part-{part}.parquet"
                        system.create_dir(f"{root}/data/{self.run}/{store}", recursive=True)
                        open_files[store] = pq.ParquetWriter(f"{root}/{path}", rows.schema, filesystem=system)
                        files.append((store, path))
                    open_files[store].write_table(rows)
        finally:
            for file in open_files.values():
                file.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = opened(self.folder)
        files = sorted(f for m in messages if m is not None for f in m.files)
        last = max((m["sequence"] for m in manifests(self.folder)), default=0)
        entry = {"sequence": last + 1, "label": self.label, "run": self.run, "replaces": self.replaces, "files": files}
        system.create_dir(f"{root}/published", recursive=True)
        aside = f"{root}/published/_{self.run}"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps(entry).encode())
        system.move(aside, f"{root}/published/{last + 1:012d}-{self.run}.json")

    def abort(self, messages: list) -> None:
        system, root = opened(self.folder)
        left = f"{root}/data/{self.run}"
        # Tasks that are being stopped may go on writing for a moment.
        for look in range(ABORT_LOOKS):
            try:
                if system.get_file_info(left).type != pyarrow.fs.FileType.NotFound:
                    system.delete_dir(left)
            except OSError:
                if look + 1 == ABORT_LOOKS:
                    raise
            time.sleep(0.1)


class PublishedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["folder"], self.options["label"], json.loads(self.options.get("replaces", "[]")))


# Executors need not have this package: what a write sends to them carries its code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write(df: DataFrame, folder: str, label: str, replaces: Sequence[str] = ()) -> None:
    """Write and publish all rows of ``df``, whose column ``store`` names the store of each; none if anything fails."""
    df.sparkSession.dataSource.register(PublishedFiles)
    (
        df.write.format(FORMAT).mode("append").option("folder", folder).option("label", label)
        .option("replaces", json.dumps(list(replaces))).save()
    )


def manifests(folder: str) -> list[dict]:
    """What has been published, in order."""
    system, root = opened(folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{root}/published", allow_not_found=True))
    out = []
    for file in found:
        if file.path.endswith(".json"):
            with system.open_input_stream(file.path) as f:
                out.append(json.loads(f.read()) | {"path": file.path})
    return sorted(out, key=lambda m: m["sequence"])


def visible(folder: str) -> dict[str, dict]:
    """The manifest that holds for each label."""
    held: dict[str, dict] = {}
    for entry in manifests(folder):
        for label in entry["replaces"]:
            held.pop(label, None)
        held[entry["label"]] = entry
    return held


def replaced(folder: str) -> set[str]:
    """Labels whose rows have gone into another label."""
    return {label for entry in manifests(folder) for label in entry["replaces"]}


def read(spark: SparkSession, folder: str, store: str, schema: str, labels: Sequence[str] | None = None) -> DataFrame:
    """The published rows of a store: of all labels, or of the given ones."""
    parts = [
        f"{folder}/{path}"
        for label, entry in visible(folder).items() if labels is None or label in labels
        for name, path in entry["files"] if name == store
    ]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def vacuum(folder: str, orphans_after: float = ORPHANS_AFTER) -> int:
    """Remove files that no reader sees any more; gives the number of writes removed.

    What a published write has been replaced by stays.  Files of writes that were never published may belong to one
    that still goes on, so they are removed only when they are ``orphans_after`` seconds old.
    """
    system, root = opened(folder)
    entries, held = manifests(folder), visible(folder)
    live, known = {entry["run"] for entry in held.values()}, {entry["run"] for entry in entries}
    gone = 0
    for run in system.get_file_info(pyarrow.fs.FileSelector(f"{root}/data", allow_not_found=True)):
        if run.base_name in live:
            continue
        if run.base_name not in known:
            inside = system.get_file_info(pyarrow.fs.FileSelector(run.path, recursive=True))
            latest = max((f.mtime.timestamp() for f in [run, *inside] if f.mtime is not None), default=0.0)
            if time.time() - latest < orphans_after:
                continue
        system.delete_dir(run.path)
        gone += 1
    # The list of replaced labels must stay known, so that a late repeat of one of them is told.
    for entry in entries:
        if entry["run"] not in live and not entry["replaces"]:
            system.delete_file(entry["path"])
    return gone
