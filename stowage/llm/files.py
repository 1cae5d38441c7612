"""Files in the shared folder, for formats that Spark does not write itself."""

from __future__ import annotations

import re

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the folder's path in it."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", uri)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(uri)


def names(uri: str, ending: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files of a folder, in order of their names."""
    store, path = open_folder(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(ending))
