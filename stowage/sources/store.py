"""Files in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyarrow import fs

BLOCK_BYTES = 1 << 20


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are on a mount."""
    mounted = re.fullmatch(r"(?:file:)?/*(/.*)", uri)
    if mounted:
        return fs.LocalFileSystem(), mounted[1]
    return fs.FileSystem.from_uri(uri)


def files_below(store: fs.FileSystem, path: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of all files below a folder, in no order; on a mount they are never held all at once."""
    if not isinstance(store, fs.LocalFileSystem):
        every = store.get_file_info(fs.FileSelector(path, recursive=True))
        while every:
            file = every.pop()
            if file.type == fs.FileType.File:
                yield file.path, file.size
        return
    folders = [path]
    while folders:
        with os.scandir(folders.pop()) as entries:
            for entry in entries:
                if entry.is_dir():
                    folders.append(entry.path)
                elif entry.is_file():
                    yield entry.path, entry.stat().st_size


class Range:
    """A stretch of an open file as a stream of its own."""

    def __init__(self, file, offset: int, length: int | None) -> None:
        self._file, self._left = file, length
        file.seek(offset)

    def read(self, size: int = -1) -> bytes:
        if self._left is not None:
            size = self._left if size is None or size < 0 else min(size, self._left)
        data = self._file.read(size if size is not None and size >= 0 else None)
        if self._left is not None:
            self._left -= len(data)
        return data

    def blocks(self) -> Iterator[bytes]:
        while data := self.read(BLOCK_BYTES):
            yield data

    def readable(self) -> bool:
        return True
