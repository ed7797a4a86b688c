"""Archives as a Spark source: zip, tar and gzip, nested to a depth, with limits, safe names and cycle detection.

An archive is one task's work, as its entries can only be read in order; a directory of them is as parallel as it has
archives.  Entries are handed out as they are read, so a worker holds the archive, one entry of each level and one
batch of entries at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.util import find_spec
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".zip": "zip", ".tar": "tar", ".tar.gz": "tar", ".tgz": "tar", ".gz": "gz", ".7z": "7z", ".rar": "rar"}
#: Packages that read the kinds the standard library can't; without one, an archive of the kind is reported.
READERS = {"7z": "py7zr", "rar": "rarfile"}
SCHEMA = "source string, virtual_path string, depth int, size bigint, sha256_hash string, content binary, problem string"


@dataclass(frozen=True)
class Limits:
    """What an entry or archive may have; None is no limit.  Entries beyond one are reported, not read."""

    max_file: int | None = None
    max_total: int | None = None
    max_count: int | None = None
    max_depth: int = 10
    gz_ratio: float | None = None
    max_path: int | None = None


#: Limits for archives that aren't trusted.
STRICT = Limits(100 << 20, 1 << 30, 1000, 10, 100.0, 1024)
#: Bytes of contents that a worker gathers before it hands them out.
BATCH_BYTES = 16 << 20


def _over(value: float, limit: float | None) -> bool:
    return limit is not None and value > limit


def kind_of(name: str) -> str | None:
    """The reader of a name, by the longest suffix it has."""
    low = name.lower()
    return next((SUFFIXES[s] for s in sorted(SUFFIXES, key=len, reverse=True) if low.endswith(s)), None)


def safe_name(name: str) -> str | None:
    """An entry's path in parts joined by ``/``, or None for an absolute, climbing or drive path."""
    if not name or name[0] in "/\\" or re.match("^[A-Za-z]:", name):
        return None
    parts = [p for p in re.split(r"[/\\]", name) if p not in ("", ".")]
    return None if ".." in parts or not parts else "/".join(parts)


def _entries(kind: str, raw: bytes, name: str, limits: Limits) -> Iterator[tuple[str, bytes | None, str | None]]:
    """Name, bytes and problem of each entry; zip and tar leave out what is beyond a limit, gzip fails as a whole."""
    if kind == "gz":
        out = gzip.GzipFile(fileobj=io.BytesIO(raw)).read(-1 if limits.max_file is None else limits.max_file + 1)
        if _over(len(out), limits.max_file) or (limits.gz_ratio is not None and len(out) > 1 << 20 and len(out) > limits.gz_ratio * len(raw)):
            raise ValueError("gzip beyond its limits")
        yield re.sub(r"\.gz$", "", name.rsplit("/", 1)[-1], flags=re.I), out, None
        return
    total = count = 0

    def check(path: str, size: int) -> tuple[str, str | None]:
        safe = safe_name(path)
        if safe is None:
            return path, "unsafe name"
        if _over(size, limits.max_file) or _over(total + size, limits.max_total) or _over(count + 1, limits.max_count):
            return safe, "beyond a limit"
        return safe, None

    if kind == "7z":
        import py7zr

        with py7zr.SevenZipFile(io.BytesIO(raw)) as z:
            infos = [i for i in z.list() if not i.is_directory]
            checked = [(i.filename, *check(i.filename, i.uncompressed)) for i in infos]
        with tempfile.TemporaryDirectory() as at, py7zr.SevenZipFile(io.BytesIO(raw)) as z:
            z.extract(at, targets=[n for n, _, bad in checked if bad is None])
            for n, path, bad in checked:
                yield path, None if bad else Path(at, n).read_bytes(), bad
    elif kind == "rar":
        import rarfile

        with rarfile.RarFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    path, bad = check(i.filename, i.file_size)
                    yield path, None if bad else z.read(i), bad
    elif kind == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                path, bad = check(i.filename, i.file_size)
                if bad is None:
                    total, count = total + i.file_size, count + 1
                yield path, None if bad else z.read(i), bad
    else:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            for m in t:
                if m.isdir():
                    continue
                path, bad = check(m.name, m.size)
                bad = bad or (None if m.isfile() else "link")
                if bad is None:
                    total, count = total + m.size, count + 1
                yield path, None if bad else t.extractfile(m).read(), bad


def expand(name: str, raw: bytes, limits: Limits = Limits()) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """Virtual path, depth, bytes and problem of everything in a file that may be an archive (depth first, own stack)."""
    stack: list[tuple[Iterator, str, int, str]] = []
    open_hashes: list[str] = []

    def enter(path: str, data: bytes, depth: int):
        kind = kind_of(path)
        digest = hashlib.sha256(data).hexdigest()
        if kind is None or depth >= limits.max_depth:
            return path, depth, data, None
        if kind in READERS and find_spec(READERS[kind]) is None:
            return path, depth, data, f"{kind} is not supported"
        if digest in open_hashes:
            return path, depth, None, "an archive within itself"
        stack.append((_entries(kind, data, path, limits), path, depth, digest))
        open_hashes.append(digest)
        return None

    if (leaf := enter(name, raw, 0)) is not None:
        yield leaf
    while stack:
        entries, base, depth, _ = stack[-1]
        try:
            path, data, bad = next(entries)
        except StopIteration:
            stack.pop()
            open_hashes.pop()
            continue
        except Exception as e:  # whatever a reader makes of a damaged archive
            stack.pop()
            open_hashes.pop()
            yield base, depth, None, f"unreadable: {e}"
            continue
        full = f"{base}/{path}"
        if _over(len(full.encode()), limits.max_path):
            yield full, depth + 1, None, "path too long"
        elif data is None:
            yield full, depth + 1, None, bad
        elif (leaf := enter(full, data, depth + 1)) is not None:
            yield leaf


def expand_archives(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every file of ``path, content``, archives expanded: rows of ``SCHEMA``, handed out ``BATCH_BYTES`` at a time."""

    def run(frames):
        rows, size = [], 0
        for f in frames:
            for src, data in zip(f["path"], f["content"], strict=True):
                for p, d, b, bad in expand(src.rsplit("/", 1)[-1], bytes(data), limits):
                    rows.append((src, p, d, None if b is None else len(b), None if b is None else hashlib.sha256(b).hexdigest(), b, bad))
                    size += len(b or b"") + 1000
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return raw.select("path", "content").mapInPandas(run, SCHEMA)


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits(), glob: str = "*") -> DataFrame:
    """Every file under ``path``, archives expanded: rows of ``SCHEMA``.  A file is one row, so of 2 GB at most."""
    return expand_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path), limits)


def read_directory(spark: SparkSession, path: str, max_depth: int | None = None) -> DataFrame:
    """Plain files under a directory: ``virtual_path, size, modified_time, sha256_hash, content``, to a depth if given."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = "/" + path.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    d = d.select(rel.alias("virtual_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_time"), F.sha2("content", 256).alias("sha256_hash"), "content")
    return d if max_depth is None else d.where(F.size(F.split("virtual_path", "/")) <= max_depth)
