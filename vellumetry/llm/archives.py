"""Files in the shared folder, opened from tasks by URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    if uri.startswith("file:"):
        uri = "file://" + uri[5:].replace("//", "", 1) if uri.startswith("file://") else "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream to a file that gets its name only when it is whole: a repeated task leaves one whole copy."""
    store, path = opened(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


def put(uri: str, parts: Iterable[bytes]) -> None:
    with writing(uri) as out:
        for p in parts:
            out.write(p)


class Files:
    """Random-access files kept open one at a time; a failed read opens the file again."""

    def __init__(self, tries: int = 3):
        self.tries, self.uri, self.file = tries, None, None

    def read(self, uri: str, offset: int = 0, size: int | None = None, good=lambda data: True) -> bytes:
        """Some bytes of a file, or all; read again, from a file opened anew, if that fails or ``good`` says no."""
        for left in reversed(range(self.tries)):
            try:
                if self.uri != uri or self.file is None:
                    self.close()
                    store, path = opened(uri)
                    self.file, self.uri = store.open_input_file(path), uri
                want = self.file.size() - offset if size is None else size
                self.file.seek(offset)
                data = self.file.read(want)
                if len(data) != want or not good(data):
                    raise OSError(f"{uri}: {len(data)} of {want} bytes at {offset}, or damaged ones")
                return data
            except OSError:
                self.close()
                if not left:
                    raise
        raise AssertionError

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = self.uri = None
