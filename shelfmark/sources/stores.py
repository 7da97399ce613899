"""Files of any store that Arrow opens by URI, seen from executors."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    # Spark writes file:/x for what others write file:///x.
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
