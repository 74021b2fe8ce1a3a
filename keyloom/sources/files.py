"""Files of any store: local paths, and whatever URI ``pyarrow.fs`` opens (``hdfs://``, ``s3://``, ``gs://``, ``abfs://``).

``pyarrow.fs`` is loaded for remote stores only: it starts threads of its own.
"""

from __future__ import annotations

import os
import posixpath
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=64)
def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)[0]


def _local(path: str) -> str | None:
    """A path of this machine, or None."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _remote(path: str) -> tuple:
    """(store, path in it)."""
    scheme, _, rest = path.partition("://")
    host, _, inner = rest.partition("/")
    # object stores have the bucket in the path
    return _store(f"{scheme}://{host}/"), "/" + inner if scheme in ("hdfs", "viewfs") else f"{host}/{inner}"


def _info(path: str):
    store, inner = _remote(path)
    return store.get_file_info(inner)


def exists(path: str) -> bool:
    here = _local(path)
    return os.path.exists(here) if here is not None else _info(path).type.name != "NotFound"


def is_folder(path: str) -> bool:
    here = _local(path)
    return os.path.isdir(here) if here is not None else _info(path).type.name == "Directory"


def size(path: str) -> int:
    here = _local(path)
    return os.path.getsize(here) if here is not None else _info(path).size


def version(path: str) -> str:
    """Size and time of the last change."""
    here = _local(path)
    if here is not None:
        found = os.stat(here)
        return f"{found.st_size} {found.st_mtime_ns}"
    return f"{_info(path).size} {_info(path).mtime_ns}"


def names(folder: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; links that lead nowhere are left out."""
    here = _local(folder)
    if here is not None:
        return sorted(n for n in os.listdir(here or ".") if os.path.exists(os.path.join(here, n)))
    from pyarrow import fs

    store, inner = _remote(folder)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)))


def read(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def open_input(path: str) -> pa.NativeFile:
    """A file open for reads at any place."""
    here = _local(path)
    if here is not None:
        return pa.OSFile(here, "rb")
    store, inner = _remote(path)
    return store.open_input_file(inner)


def open_output(path: str) -> pa.NativeFile:
    """A new file, with the folders above it."""
    here = _local(path)
    if here is not None:
        os.makedirs(os.path.dirname(os.path.abspath(here)), exist_ok=True)
        return pa.OSFile(here, "wb")
    store, inner = _remote(path)
    store.create_dir(posixpath.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def write(path: str, content: bytes) -> None:
    with open_output(path) as f:
        f.write(content)


def delete(path: str) -> None:
    """Delete a file, if it is there."""
    here = _local(path)
    if here is not None:
        if os.path.isfile(here):
            os.remove(here)
    elif _info(path).type.name == "File":
        store, inner = _remote(path)
        store.delete_file(inner)


def rename(path: str, to: str) -> None:
    here, there = _local(path), _local(to)
    if here is not None and there is not None:
        os.replace(here, there)
    else:
        store, inner = _remote(path)
        store.move(inner, _remote(to)[1])


def join(folder: str, *parts: str) -> str:
    return posixpath.join(folder or ".", *parts)


def folder_of(path: str) -> str:
    return posixpath.dirname(path)


def name_of(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def absolute(path: str) -> str:
    return posixpath.normpath(os.path.abspath(path)) if "://" not in path else path


def find(path: str) -> str | None:
    """The path, or a file of the same folder whose name differs by case only."""
    if exists(path):
        return path
    folder, name = posixpath.split(path)
    same = [n for n in names(folder or ".") if n.lower() == name.lower()] if is_folder(folder or ".") else []
    return join(folder, same[0]) if same else None
