"""Files that tasks write under the shared folder and list in a table.

A task writes under a name of its own and the names reach a written table only when
the task is done, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


class Output:
    """A new file in a folder given as URI or path."""

    def __init__(self, folder: str, prefix: str, suffix: str) -> None:
        self.uri = f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"
        system, path = place(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.stream.close()
        return self.uri


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
