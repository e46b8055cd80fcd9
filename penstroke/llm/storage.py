"""Files that tasks write and read themselves, in the shared folder."""

from __future__ import annotations

import re

from pyarrow import fs


def native_uri(folder: str) -> str:
    """The URI as the writer knows it; Hadoop names S3 by its connectors."""
    return re.sub(r"^s3[an]://", "s3://", folder)


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(native_uri(folder))
