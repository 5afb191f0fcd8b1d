"""Files of any store that Spark lists and tasks open by themselves."""

from __future__ import annotations

from urllib.parse import quote


def place(uri: str):
    """The file system of a URI or path, as pyarrow knows it, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("s3://" + uri.split("://", 1)[1] if uri.startswith(("s3a://", "s3n://")) else uri)


def opened(uri: str):
    """A file for reading at any offset."""
    system, path = place(uri)
    return system.open_input_file(path)


def escaped(name: str) -> str:
    """A file name for any text, different for different texts: all but letters, digits, ``_`` and ``-``, and dots within, as per cent codes."""
    return quote(name, safe="").replace("~", "%7E").replace(".", "%2E", 1 if name.startswith(".") else 0) or "%"
