"""File systems of paths as Spark names them, for code that reads and writes bytes in Python workers."""

from __future__ import annotations

import os

from pyarrow import fs as pafs

#: Schemes of Hadoop's connectors, and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(path: str) -> str:
    scheme, found, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{found}{rest}" if found else path


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path in it. A path without a scheme is local. hdfs:// needs libhdfs on every worker."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(arrow_uri(path)) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
