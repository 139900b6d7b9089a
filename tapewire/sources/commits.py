"""The list of files that a stored table consists of.

A table is the files that its newest list names, not those that lie in its folder. A writer puts new files
beside the old ones and then a new list beside the old one, under the next number and by one rename. Until then readers
see the table as it was, after that as it is; files of the list before stay one commit longer, for readers
that began with it. The list also says up to which micro-batch each stream has been merged, so a
batch that is played again is known as such.

Lists are in ``_lists``, a name that readers of parquet folders pass over.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

_LISTS = "_lists"


class Disk:
    """The file system that a table is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.of(path))

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.of(new).getParent())
        if self.exists(new) or not self.fs.rename(self.of(old), self.of(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.of(path), True)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.of(folder)))

    def data_files(self, folder: str) -> list[str]:
        """Paths, from the folder, of the parquet files in and below it."""
        base = self.fs.makeQualified(self.of(folder)).toUri().getPath().rstrip("/") + "/"
        found, out = self.fs.listFiles(self.of(folder), True), []
        while found.hasNext():
            path = found.next().getPath().toUri().getPath()
            name = path.removeprefix(base)
            if name.endswith(".parquet") and not any(part.startswith(("_", ".")) for part in name.split("/")):
                out.append(name)
        return sorted(out)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.of(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.of(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


@dataclass(frozen=True)
class FileList:
    """What a table consists of.

    ``files``: paths from the table's folder. ``parts``: its partition columns. ``names``: of a price table, the ticker of
    each path key. ``batches``: the last micro-batch merged of each stream.
    """

    number: int = 0
    parts: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def of_folders(self, folders: Iterable[str]) -> list[str]:
        wanted = set(folders)
        return [f for f in self.files if f.rpartition("/")[0] in wanted]

    def has_merged(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


def newest(disk: Disk) -> FileList | None:
    """The list that counts, or None where the table has none."""
    lists = [n for n in disk.names(f"{disk.root}/{_LISTS}") if n.endswith(".json")]
    return FileList(**json.loads(disk.read(f"{disk.root}/{_LISTS}/{lists[-1]}"))) if lists else None


def commit(disk: Disk, before: FileList | None, after: FileList) -> None:
    """Make ``after`` the list that counts. Fails where another writer has put a list there since ``before`` was read."""
    folder = f"{disk.root}/{_LISTS}"
    number = (before.number if before else 0) + 1
    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
    disk.write(draft, json.dumps(asdict(after) | {"number": number}))
    try:
        disk.move(draft, f"{folder}/{number:012d}.json")
    except OSError:
        disk.remove(draft)
        raise
    _clean(disk, folder, keep={*after.files, *(before.files if before else ())})


def _clean(disk: Disk, folder: str, keep: set[str]) -> None:
    """Remove the lists before the last two, and the files that only these name."""
    for name in [n for n in disk.names(folder) if n.endswith(".json")][:-2]:
        for file in json.loads(disk.read(f"{folder}/{name}"))["files"]:
            if file not in keep:
                disk.remove(f"{disk.root}/{file}")
        disk.remove(f"{folder}/{name}")
