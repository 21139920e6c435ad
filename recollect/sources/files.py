"""Files of the cluster's shared folders, opened by their address from the driver or a task."""

from __future__ import annotations

from pyarrow import fs

#: Addresses that Spark and Arrow spell differently.
_ARROW = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def system(address: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of an address (file, hdfs, s3a, gs, abfss), and the path in it."""
    scheme, mark, rest = address.partition("://")
    if not mark and address.startswith("file:"):
        return fs.FileSystem.from_uri(f"file://{address.removeprefix('file:')}")
    return fs.FileSystem.from_uri(f"{_ARROW.get(scheme, scheme)}://{rest}" if mark else address)
