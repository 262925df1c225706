"""Data source ``page_files``: a writer that names one file per row.

Rows are (crawl_id string, output_path string, markdown string); the file is
``<path>/<run>/<crawl_id>/<output_path>``, on whatever store the URI of ``path`` names. A task
writes its files to a staging folder of its own (``<path>/<run>/_staging/<attempt>``), moves them to their
names once it has all rows, and says so in its commit message; a task that fails deletes its staging
folder, so none of its files is visible. When all tasks are done the driver writes ``_SUCCESS`` with
the counts from the messages (one per task) and drops the staging folder; an aborted job leaves no
``_SUCCESS``. A rerun with the same ``run`` overwrites its own files and touches no other run's.
Attempts of one task write the same bytes to the same names, so speculative ones do no harm.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, DONE = "_staging", "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


def _store(path: str):
    """The file system of a URI or plain path, and the path on it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def safe_path(output_path: str) -> str:
    """The path without steps that leave its folder."""
    parts = [p for p in output_path.split("/") if p]
    return "/".join("%2E" * len(p) if p in (".", "..") else p for p in parts)


def files_of(base: str, crawl_id: str, rows: int = 4096) -> Iterator:
    """Arrow batches (name, n_bytes, sha256) of the ``.md`` files in the folder of one crawl."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    store, root = _store(base)
    folder = f"{root}/{crawl_id}/".lstrip("/")
    found = store.get_file_info(fs.FileSelector(f"{root}/{crawl_id}", allow_not_found=True, recursive=True))
    found = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".md")]
    for start in range(0, len(found), rows):
        out = []
        for f in found[start : start + rows]:
            with store.open_input_stream(f.path) as body:
                data = body.read()
            out.append((f"{crawl_id}/{f.path[f.path.index(folder) + len(folder) :]}", len(data), hashlib.sha256(data).hexdigest()))
        names, sizes, digests = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                         names=["name", "n_bytes", "sha256"])


class PageFilesWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = f"{options['path'].rstrip('/')}/{options.get('run', 'pages')}"

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.root)
        staging = f"{root}/{STAGING}/{uuid.uuid4().hex}"
        store.create_dir(staging)
        done, size = [], 0
        try:
            for k, row in enumerate(rows):
                data = (row["markdown"] or "").encode("utf-8", "surrogatepass")
                with store.open_output_stream(f"{staging}/{k}") as out:
                    out.write(data)
                done.append(f"{root}/{row['crawl_id']}/{safe_path(row['output_path'])}")
                size += len(data)
            for folder in {name.rsplit("/", 1)[0] for name in done}:
                store.create_dir(folder)
            for k, name in enumerate(done):
                store.move(f"{staging}/{k}", name)
        finally:
            store.delete_dir(staging)
        return Written(len(done), size)

    def commit(self, messages: list) -> None:
        store, root = _store(self.root)
        store.create_dir(root)
        said = [m for m in messages if m is not None]
        with store.open_output_stream(f"{root}/{DONE}") as out:
            out.write(json.dumps({"files": sum(m.files for m in said), "bytes": sum(m.bytes for m in said)}).encode())
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        store, root = _store(self.root)
        self._clear(store, root)

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}")


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "crawl_id string, output_path string, markdown string"

    def writer(self, schema, overwrite: bool) -> PageFilesWriter:
        return PageFilesWriter(dict(self.options))
