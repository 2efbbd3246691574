"""Directory trees: listed on the driver, read by executors.

Only names and sizes pass the driver; contents are read by the binary file
source in parallel.  For trees of many millions of files give ``glob`` the
pattern instead: Spark then lists in parallel too.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import normalize_exts

SKIP_DIRS = frozenset(".eggs .git .hg .idea .mypy_cache .nox .pytest_cache .ruff_cache .svn .tox .venv .vscode __pycache__ build dist env node_modules target venv".split())
MAX_BYTES = 200 << 20


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file."""

    base: str
    pattern: re.Pattern
    negated: bool
    only_dirs: bool

    def hits(self, path: str, is_dir: bool) -> bool:
        if self.only_dirs and not is_dir:
            return False
        if self.base and not path.startswith(self.base + "/"):
            return False
        return bool(self.pattern.fullmatch(path[len(self.base) + 1 :] if self.base else path))


def _regex(glob: str, anchored: bool) -> re.Pattern:
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + fnmatch.translate(glob[i : end + 1])[4:].partition(")")[0], end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out, re.S)


def parse_rules(text: str, base: str = "") -> list[Rule]:
    out = []
    for line in text.splitlines():
        row = line.rstrip()
        if not row or row.startswith("#"):
            continue
        negated = row.startswith("!")
        row = row[negated:]
        only_dirs = row.endswith("/")
        row = row.rstrip("/")
        anchored = "/" in row
        if row:
            out.append(Rule(base, _regex(row.lstrip("/"), anchored), negated, only_dirs))
    return out


def ignored(rules: list[Rule], path: str, is_dir: bool) -> bool:
    """The last rule that hits decides."""
    hit = next((r for r in reversed(rules) if r.hits(path, is_dir)), None)
    return hit is not None and not hit.negated


def walk(root: str, include=None, exclude=None, hidden: bool = False, gitignore: bool = True, max_bytes: int | None = MAX_BYTES, links: bool = False, skip_dirs=SKIP_DIRS):
    """(relative path, size) of the regular files of a tree that pass, in order of folded names.  Links out of the tree never pass."""
    top = Path(root).resolve()
    if not top.is_dir():
        raise NotADirectoryError(root)
    want, drop = normalize_exts(include), normalize_exts(exclude)

    def inside(p: Path) -> bool:
        return p.resolve().is_relative_to(top)

    def go(folder: Path, rel: str, rules: list[Rule]):
        own = folder / ".gitignore"
        if gitignore and own.is_file():
            rules = rules + parse_rules(own.read_text("utf-8", "replace"), rel)
        entries = sorted(os.scandir(folder), key=lambda e: (e.name.casefold(), e.name))
        dirs = []
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if (not hidden and e.name.startswith(".")) or (e.is_symlink() and not (links and inside(Path(e.path)))):
                continue
            if e.is_dir():
                if e.name not in skip_dirs and not ignored(rules, path, True):
                    dirs.append((e, path))
            elif e.is_file() and not ignored(rules, path, False):
                ext, size = os.path.splitext(e.name)[1].lower(), e.stat().st_size
                if (want is None or ext in want) and (drop is None or ext not in drop) and (max_bytes is None or size <= max_bytes):
                    yield path, size
        for e, path in dirs:
            yield from go(Path(e.path), path, rules)

    yield from go(top, "", [])


def local_dir(spark: SparkSession, root: str, include=None, exclude=None, hidden: bool = False, gitignore: bool = True, max_bytes: int | None = MAX_BYTES, links: bool = False, prefix_bytes: int | None = None, skip_dirs=SKIP_DIRS) -> DataFrame:
    """path (relative), content, size of the files of a tree.  prefix_bytes cuts the content; size stays the file's."""
    top = str(Path(root).resolve())
    found = [f"{top}/{p}" for p, _ in walk(root, include, exclude, hidden, gitignore, max_bytes, links, skip_dirs)]
    if not found:
        return spark.createDataFrame([], "path string, content binary, size long")
    raw = spark.read.format("binaryFile").load([p.replace("\\", "\\\\").replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in found])
    return _files(raw, top, prefix_bytes)


def _files(raw: DataFrame, top: str, prefix_bytes: int | None) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), rf"^\Q{top.rstrip('/')}\E/", "")
    content = F.substring("content", 1, prefix_bytes) if prefix_bytes else F.col("content")
    return raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), content.alias("content"), F.col("length").alias("size"))


def glob(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int | None = MAX_BYTES, prefix_bytes: int | None = None) -> DataFrame:
    """path, content, size of all files below root (any file system) whose name fits the pattern; the size bound is pushed to the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    return _files(raw, str(Path(root).resolve()) if "://" not in root else root, prefix_bytes).dropDuplicates(["path"])


def git_context(root: str) -> dict[str, str]:
    """repo and repo_url of a working copy from the address of its origin, credentials left out; empty if there is none."""
    import configparser

    parser = configparser.ConfigParser(strict=False, interpolation=None)
    try:
        parser.read_string(re.sub(r"(?m)^[ \t]+", "", (Path(root) / ".git" / "config").read_text("utf-8", "replace")))
        url = parser['remote "origin"']["url"]
    except (OSError, KeyError, configparser.Error):
        return {}
    m = re.match(r"(?:[a-z+]+://)?(?:[^@/]*@)?([^/:]+)(?::\d+)?[/:](.+?)(?:\.git)?/?$", url)
    return {"repo": m[2], "repo_url": f"https://{m[1]}/{m[2]}"} if m and "/" in m[2] else {}
