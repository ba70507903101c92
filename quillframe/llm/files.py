"""Files that tasks write into the shared folder through Arrow's filesystems.

A task writes under a name of its own and reports the path as a row; only rows of successful attempts reach the
written manifest, so a lost executor leaves at most an unreferenced file.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def fresh(directory: str, stem: str, suffix: str) -> str:
    return f"{directory}/{stem}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    fs, path = located(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def opened(uri: str):
    """Random access; memory-mapped where the file is local."""
    fs, path = located(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pafs.LocalFileSystem(use_mmap=True).open_input_file(path)
    return fs.open_input_file(path)
