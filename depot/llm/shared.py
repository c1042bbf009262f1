"""Files of the operators' own formats in the folder that all executors share.

Tasks write a file under a name of its own and report it as a row; only reported files
count, so the file of a lost or repeated attempt is never read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow.fs as fs
from pyspark.sql import SparkSession


def new_path(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def create(path: str):
    """A stream that writes a new file; `path` is a URI or an absolute path."""
    system, local = fs.FileSystem.from_uri(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(local, compression=None)


def reader(path: str):
    """A file for reads at any place."""
    system, local = fs.FileSystem.from_uri(path)
    return system.open_input_file(local)


def read_at(file, start: int, length: int) -> bytes:
    return file.read_at(length, start) if length else b""


def local_copy(path: str) -> str:
    """A local path of a shared file, for memory maps.

    A folder that the nodes mount is mapped in place, so the system keeps one copy of its
    pages for all workers of a node. Other stores are copied to the worker's own folder once.
    """
    system, local = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return local
    if path not in _copies:
        folder = tempfile.mkdtemp(prefix="depot-map-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _copies[path] = f"{folder}/file"
        fs.copy_files(path, _copies[path])
    return _copies[path]


_copies: dict[str, str] = {}


def tasks_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed on them."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = held.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
