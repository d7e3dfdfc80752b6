"""Files behind the data sources: local paths and whatever pyarrow's file systems open."""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def expand(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files of a path: one file, a folder, a pattern, or several of these joined by commas, in order."""
    out: list[str] = []
    for p in (x.strip() for x in path.split(",")):
        fs, q = resolve(p)
        if isinstance(fs, pafs.LocalFileSystem) and any(ch in q for ch in "*?["):
            out += sorted(glob.glob(q))
            continue
        info = fs.get_file_info(q)
        if info.type == pafs.FileType.Directory:
            prefix = p[: len(p) - len(q)] if p.endswith(q) else ""
            out += sorted(prefix + f.path for f in fs.get_file_info(pafs.FileSelector(q)) if f.path.lower().endswith(suffixes))
        elif info.type == pafs.FileType.File:
            out.append(p)
        else:
            raise FileNotFoundError(p)
    return out


def size_of(path: str) -> int:
    fs, q = resolve(path)
    return fs.get_file_info(q).size


def exists(path: str) -> bool:
    fs, q = resolve(path)
    return fs.get_file_info(q).type == pafs.FileType.File


def read_bytes(path: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, q = resolve(path)
    with fs.open_input_file(q) as f:
        n = f.size() - offset if length is None else min(length, f.size() - offset)
        return f.read_at(max(n, 0), offset)


def write_bytes(path: str, data: bytes) -> None:
    fs, q = resolve(path)
    parent = os.path.dirname(q)
    if parent:
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(q) as f:
        f.write(data)


def delete(path: str) -> None:
    fs, q = resolve(path)
    if fs.get_file_info(q).type == pafs.FileType.File:
        fs.delete_file(q)


def unused(path: str) -> str:
    """The path, or with a number before its suffix if the file is there already."""
    if not exists(path):
        return path
    stem, ext = os.path.splitext(path)
    k = 1
    while exists(f"{stem}_{k}{ext}"):
        k += 1
    return f"{stem}_{k}{ext}"


@dataclass
class Range(InputPartition):
    """Records first to last (exclusive) of a file; info: what its reader knows of the header."""

    path: str
    first: int
    last: int
    info: dict

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Part(WriterCommitMessage):
    """A written piece: its file and its place in the order."""

    path: str
    order: tuple
    info: dict


def ranges(path: str, records: int, info: dict, each: int) -> list[Range]:
    return [Range(path, i, min(i + each, records), info) for i in range(0, max(records, 1), each)]


def pruned(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names], names=names)
