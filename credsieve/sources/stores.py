"""Folders and files of stores that a URI names.

A task opens the store itself, so nothing has to be mounted on the executors. Stores that
pyarrow knows (file, hdfs, s3, gs) need no more than the URI; for others a function
``open_store(uri)`` gives a pyarrow file system and the path in it. Names are quoted in URIs.
"""

import io
import os
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs

#: What a store may raise for a file, a folder or a URI.
ERRORS = (OSError, pa.ArrowException, UnicodeDecodeError)


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def open_uri(uri: str):
    """The file system that pyarrow knows for a URI, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _row(uri, info, is_root=False):
    if info.type == fs.FileType.NotFound:
        return uri, False, None, None, is_root, "not found"
    changed = None if info.mtime_ns is None else info.mtime_ns // 1_000_000
    return uri, info.type == fs.FileType.Directory, info.size, changed, is_root, None


def root_entry(uri: str, open_store=None):
    """Path, is_dir, length, modified_ms, is_root and error of a root."""
    try:
        store, path = (open_store or open_uri)(uri)
        return _row(uri, store.get_file_info(path), True)
    except ERRORS as error:
        return uri, False, None, None, True, str(error)


def folder_entries(uri: str, open_store=None):
    """The same of each entry of a folder; the folder itself with an error if it cannot
    be read. Local links to folders are not followed: they may form a cycle."""
    try:
        store, path = (open_store or open_uri)(uri)
        found = store.get_file_info(fs.FileSelector(path))
    except ERRORS as error:
        yield uri, False, None, None, False, str(error)
        return
    below = uri if uri.endswith("/") else uri + "/"
    local = isinstance(store, fs.LocalFileSystem)
    for info in found:
        if not (local and info.type == fs.FileType.Directory and os.path.islink(info.path)):
            yield _row(below + quote(info.base_name), info)


class Reader:
    """Texts of files; each folder's store is opened once."""

    def __init__(self, open_store=None, kept=64):
        self.open_store, self.kept, self.folders = open_store or open_uri, kept, {}

    def _folder(self, uri):
        if uri not in self.folders:
            if len(self.folders) == self.kept:
                self.folders.clear()
            self.folders[uri] = self.open_store(uri)
        return self.folders[uri]

    def text(self, uri: str):
        """Text and error of a file; one of them is None."""
        try:
            cut = uri.rindex("/") + 1
            store, path = self._folder(uri[:cut])
            name = unquote(uri[cut:])
            with store.open_input_file(f"{path.rstrip('/')}/{name}" if path else name) as source:
                return io.TextIOWrapper(source, encoding="utf-8").read(), None
        except ERRORS as error:
            return None, str(error)
