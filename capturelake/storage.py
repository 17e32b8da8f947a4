"""Files of a job's output folder, on this machine or wherever a URI (hdfs, s3, gs, file) leads; also from inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a path without a scheme is one of this machine."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


@contextmanager
def whole_file(path: str) -> Iterator[IO[bytes]]:
    """A stream whose file appears when it is closed: a task that dies leaves none, one that is repeated writes the same."""
    where, name = place(path)
    if "/" in name:
        where.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex[:8]}.part"
    with where.open_output_stream(part, compression=None) as out:
        yield out
    where.move(part, name)


def put(path: str, data: bytes | pa.Buffer) -> None:
    with whole_file(path) as out:
        out.write(data)


@contextmanager
def opened(path: str) -> Iterator[IO[bytes]]:
    """A stream of the file's bytes."""
    where, name = place(path)
    with where.open_input_stream(name, compression=None) as f:
        yield f


def get(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def exists(path: str) -> bool:
    where, name = place(path)
    return where.get_file_info(name).type == fs.FileType.File


def names(folder: str) -> list[str]:
    """Names of the files and folders in ``folder``; none if it is not there."""
    where, base = place(folder)
    return sorted(i.base_name for i in where.get_file_info(fs.FileSelector(base or ".", allow_not_found=True)))
