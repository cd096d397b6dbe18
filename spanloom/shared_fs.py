"""Files in the shared folder, opened from Python on any machine through pyarrow's file systems."""

from __future__ import annotations


def open_fs(uri: str):
    """(file system, path) of a URI, whose path is taken as it is written; Hadoop's s3a: is s3: here."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    authority, _, path = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/{quote(path)}")
