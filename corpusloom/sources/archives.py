"""Zip archives, such as a forge's download of a repository, read within limits."""

from __future__ import annotations

import io
import stat
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import normalize_exts

MAX_MEMBERS, MAX_TOTAL, MAX_RATIO, MAX_FILE = 200_000, 2 << 30, 100, 200 << 20


class ArchiveLimit(ValueError):
    """An archive exceeds a limit."""


def safe_path(name: str) -> str | None:
    """A member's relative path, or None if it would leave the folder."""
    parts = name.translate({92: 47}).split("/")
    if name.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or any(ord(c) < 32 for c in name):
        return None
    return "/".join(p for p in parts if p not in ("", ".")) or None


def members(data: bytes, subpath: str | None = None, include=None, strip_top: bool = True, max_members: int = MAX_MEMBERS, max_total: int = MAX_TOTAL, max_ratio: int = MAX_RATIO, max_file: int = MAX_FILE):
    """(path, content, size) of the regular members in order of folded path.

    Unsafe paths, links, encrypted and oversized members are left out; too many members, too many bytes or too high a ratio is an error.
    """
    want = normalize_exts(include)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > max_members:
            raise ArchiveLimit(f"{len(infos)} members")
        tops = {i.filename.split("/")[0] for i in infos}
        top = f"{next(iter(tops))}/" if strip_top and len(tops) == 1 and all("/" in i.filename for i in infos) else ""
        found, total = [], 0
        for i in infos:
            path = safe_path(i.filename[len(top) :])
            if i.is_dir() or path is None or safe_path(i.filename) is None or stat.S_ISLNK(i.external_attr >> 16) or i.flag_bits & 1 or i.file_size > max_file:
                continue
            if subpath and not path.startswith(subpath.strip("/") + "/"):
                continue
            if i.file_size > max_ratio * max(1, i.compress_size):
                raise ArchiveLimit(f"{i.filename} is compressed {i.file_size}:{i.compress_size}")
            total += i.file_size
            if total > max_total:
                raise ArchiveLimit(f"over {max_total} bytes")
            if want is None or "." + path.rpartition(".")[2].lower() in want:
                found.append((path, i))
        for path, i in sorted(found, key=lambda x: (x[0].casefold(), x[0])):
            with z.open(i) as f:
                content = f.read(i.file_size + 1)  # a member can't unpack to more than it says
            if len(content) == i.file_size:
                yield path, content, i.file_size


def unzip(archives: DataFrame, content: str = "content", path: str = "path", **options) -> DataFrame:
    """archive, path, content, size for each member of each archive; archives are unpacked in parallel, one row a member."""

    def run(batches):
        for b in batches:
            for name, data in zip(b[path], b[content], strict=True):
                rows = []
                for p, c, n in members(bytes(data), **options) if data else ():
                    rows.append((name, p, c, n))
                    if sum(r[3] for r in rows) > 32 << 20:
                        yield pd.DataFrame(rows, columns=["archive", "path", "content", "size"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "content", "size"])

    return archives.select(path, content).mapInPandas(run, "archive string, path string, content binary, size long")


def zip_files(spark: SparkSession, path: str, subpath: str | None = None, include=None, strip_top: bool = True) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    return unzip(raw.select("path", F.col("content")), subpath=subpath, include=include, strip_top=strip_top)
