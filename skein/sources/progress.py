"""What the streaming sources share: stores, the offset offered last, and fair shares of a step."""

from __future__ import annotations

import json

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Progress:
    """The offset that a source offered last, in a folder of its query's own.

    Spark asks for the next offset without saying where the query stands; after a restart this file
    does. It is written before an offset is offered and hence never behind the checkpoint.
    """

    def __init__(self, folder: str):
        self._fs, self._folder = opened(folder.rstrip("/"))

    def save(self, offset: dict) -> None:
        self._fs.create_dir(self._folder, recursive=True)
        with self._fs.open_output_stream(f"{self._folder}/new.json") as f:
            f.write(json.dumps(offset).encode())
        self._fs.move(f"{self._folder}/new.json", f"{self._folder}/offset.json")

    def load(self) -> dict | None:
        path = f"{self._folder}/offset.json"
        if self._fs.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self._fs.open_input_stream(path) as f:
            return json.loads(f.read())


def files(store: fs.FileSystem, root: str) -> dict[str, fs.FileInfo]:
    """The files below ``root`` by their path in it; hidden ones and those in hidden folders are left out."""
    every = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = {f.path[len(root) :].lstrip("/"): f for f in every if f.is_file}
    return {p: f for p, f in sorted(names.items()) if not any(part[:1] in "._" for part in p.split("/"))}


def shares(wants: dict[str, int], total: int) -> dict[str, int]:
    """``total`` shared out: who wants least comes first, and nobody gets more than wanted."""
    out, left = {}, total
    for i, (name, want) in enumerate(sorted(wants.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(want, left // (len(wants) - i))
        left -= out[name]
    return out
