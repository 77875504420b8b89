"""Binary files in the shared folder, read and written on executors through pyarrow's file systems (file, hdfs, s3, ...)."""

from __future__ import annotations

from functools import lru_cache

import pyarrow.fs as pafs


@lru_cache(maxsize=64)
def _system(root: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(root)[0]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = uri.rpartition("://")
    if not scheme:
        scheme, _, rest = uri.partition(":") if uri.startswith("file:") else ("file", "", uri)
    if scheme == "file":
        return _system("file:///"), "/" + rest.lstrip("/")
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def write_file(uri: str, data: bytes, final: str | None = None) -> None:
    """Writes a file; with final it is written whole and then moved there, over what a task before it left."""
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)
    if final:
        system.move(path, _place(final)[1])


def read_file(uri: str) -> bytes:
    system, path = _place(uri)
    with system.open_input_file(path) as f:
        return f.read()


def read_ranges(uri: str, ranges):
    """The bytes of each (offset, length) of one file."""
    system, path = _place(uri)
    with system.open_input_file(path) as f:
        for offset, length in ranges:
            f.seek(offset)
            yield f.read(length)
