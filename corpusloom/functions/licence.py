"""Licences of repositories: SPDX expressions, headers, manifests, licence texts and Creative Commons notices."""

from __future__ import annotations

import json
import re
import tomllib
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LATER = "either version {} of the license, or (at your option) any later version"
_GNU = "gnu {}general public license"
_AS_IS = "the software is provided as is"
_GRANT = "permission is hereby granted, free of charge"
_FREE = "this is free and unencumbered software released into the public domain"
_BSD = "redistribution and use in source and binary forms, with or without modification"
_CC = "creative commons attribution"
CC_IDS = ["CC0-1.0", *(f"CC-BY-{k}4.0" for k in ("", "SA-", "ND-", "NC-", "NC-SA-", "NC-ND-")), *(f"CC-BY-{k}3.0" for k in ("", "SA-"))]
CC_PATHS = {"CC0-1.0": "creativecommons.org/publicdomain/zero/1.0/", **{i: f"creativecommons.org/licenses/{i[3:-4].lower()}/{i[-3:]}/" for i in CC_IDS[1:]}}
#: In order: the first licence all of whose phrases a text holds.
PHRASES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", (_AS_IS, _GRANT)),
    ("Apache-2.0", ("apache.org/licenses/license-2.0", "apache license, version 2.0, january 2004")),
    ("BSD-3-Clause", ("neither the name of", _BSD)),
    ("BSD-2-Clause", ("this software is provided by the copyright holders", _BSD)),
    ("BSD-4-Clause", ("all advertising materials mentioning features or use of this software", _BSD)),
    ("MPL-2.0", ("exhibit a - source code form license notice", "mozilla public license version 2.0")),
    *((f"GPL-{v}.0-or-later", (_GNU.format(""), _LATER.format(v))) for v in (3, 2)),
    *((f"GPL-{v}.0-only", (_GNU.format(""), f"version {v}")) for v in (3, 2)),
    ("LGPL-3.0-or-later", (_GNU.format("lesser "), _LATER.format(3))),
    ("LGPL-3.0-only", (_GNU.format("lesser "), "version 3")),
    ("AGPL-3.0-only", (_GNU.format("affero "), "version 3")),
    ("AGPL-3.0-or-later", (_GNU.format("affero "), _LATER.format(3))),
    ("EPL-2.0", ("eclipse.org/legal/epl-2.0", "eclipse public license version 2.0")),
    ("CC0-1.0", ("creative commons corporation is not a law firm", "cc0 1.0 universal")),
    ("BSL-1.0", ("boost software license", f"{_GRANT}, to any person or organization " + "obtaining a copy of the software")),
    ("Unlicense", (_FREE,)),
    ("ISC", (f"{_AS_IS} and the author disclaims", "permission to use, copy, modify, " + "and/or distribute this software for any purpose")),
    ("CC-BY-4.0", (f"{_CC} 4.0 international public license",)),
    *((f"CC-BY-{code}-4.0", (f"{_CC}-{words} 4.0 international", f"creativecommons.org/licenses/by-{code.lower()}/4.0/")) for code, words in (("SA", "sharealike"), ("ND", "noderivatives"), ("NC", "noncommercial"), ("NC-SA", "noncommercial-sharealike"), ("NC-ND", "noncommercial-noderivatives"))),
    ("CC-BY-3.0", (f"{_CC} 3.0 unported",)),
    ("CC-BY-SA-3.0", (CC_PATHS["CC-BY-SA-3.0"], f"{_CC}-sharealike 3.0 unported")),
]
_MORE = "0BSD AAL BSD-2-Clause-Patent BSD-3-Clause-Clear CC-BY-2.0 CC-BY-2.5 CC-BY-SA-2.0 CC-BY-SA-2.5 EUPL-1.2 LGPL-2.1-only LGPL-2.1-or-later MIT-0 Zlib"
SPDX_IDS = {n for n, _ in PHRASES} | set(CC_IDS) | set(_MORE.split())
EXCEPTIONS = {f"{n}-exception-{v}" for n, v in (("Autoconf", "2.0"), ("Autoconf", "3.0"), ("Bison", "2.2"), ("Classpath", "2.0"), ("Font", "2.0"), ("GCC", "2.0"), ("GCC", "3.1"), ("WxWindows", "3.1"), ("OpenJDK-assembly", "1.0"), ("Universal-FOSS", "1.0"))} | {f"{n}-exception" for n in "LLVM OpenSSL GPL-3.0-linking OCaml-LGPL-linking".split()}
_OWN = re.compile(r"(?:DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+$")
_HEADER = re.compile(r"SPDX-License-Identifier:[ \t]*([^\s*][^*\n]*)", re.I)
_FILES = tuple("license license.txt license.md license.rst license-mit license-apache licence licence.txt copying copying.txt copying.md copying.lesser unlicense".split())
_SKIPPED = re.compile(r"(?:vendor|third[_-]party|deps|node_modules|\.git|submodules|dist|build)/")
_CC_URL = re.compile(r"https?://creative" r"commons\.org/(?:publicdomain|licenses)/[a-z-]+/[\d.]+(?:/[a-z\d.-]+)*/?", re.I)
_SCOPES = tuple(f"{w} licensed under" for w in ("this work is", "this project is", "this repository is", "this content is", "this documentation is", "the contents of this repository are"))
HEADER_FILES, HEADER_BYTES, TEXT_BYTES = 200, 32 << 10, 128 << 10


def spdx(expression: str) -> str | None:
    """The expression in normal form, or None if it isn't one of known identifiers, AND, OR, WITH and brackets."""
    out: list[str] = []
    depth, operand, after_with = 0, True, False
    last = ""
    for t in re.findall(r"[()]|[^\s()]+", expression):
        if after_with:
            if t not in EXCEPTIONS and not _OWN.match(t):
                return None
            after_with, last = False, "exception"
        elif operand and t == "(":
            depth += 1
        elif operand and (t in SPDX_IDS or _OWN.match(t)):
            operand, last = False, "id"
        elif not operand and t.upper() == "WITH" and last == "id":
            after_with, t = True, "WITH"
        elif not operand and t.upper() in ("AND", "OR"):
            operand, t = True, t.upper()
        elif not operand and t == ")" and depth:
            depth, last = depth - 1, ")"
        else:
            return None
        out.append(t)
    if operand or depth or after_with:
        return None
    return re.sub(r"(?<=\() | (?=\))", "", " ".join(out))


def match_text(text: str) -> str | None:
    plain = text.lower().translate({34: None, 39: None})
    return next((name for name, phrases in PHRASES if all(p in plain for p in phrases)), None)


def digest(text: str) -> str:
    return sha256(text.encode(errors="ignore")).hexdigest()


def _found(expression: str, path: str, method: str, hashed: str | None = None, **more) -> dict:
    return {"license": expression, "license_path": path, "detect_method": method, "license_sha256": digest(hashed if hashed is not None else expression), **more}


def _normal(text: str) -> str:
    return "\n".join(r.rstrip() for r in text.splitlines()).strip()


def from_headers(files: dict[str, str]) -> dict | None:
    looked = 0
    for path, text in files.items():
        if looked >= HEADER_FILES:
            break
        head = text[:HEADER_BYTES]
        if not head or _SKIPPED.search(path.lower()):
            continue
        m = _HEADER.search(head)
        if m and (e := spdx(m[1].strip())):
            return _found(e, path, "spdx_header")
        looked += 1
    return None


def _referenced(name: str, root: dict[str, tuple[str, str]]) -> dict | None:
    """The licence of a root file that a manifest names."""
    entry = root.get(name.strip().strip("./").lower())
    if entry and entry[1] and (e := match_text(entry[1])):
        return _found(e, entry[0], "manifest", _normal(entry[1]))
    return None


def _declared(data: dict, kind: str, path: str, root) -> dict | None:
    if kind == "package.json":
        v = data.get("license")
        if not isinstance(v, str):
            return None
        if v.strip().upper().startswith("SEE LICENSE IN "):
            return _referenced(v.strip()[15:], root)
        e = spdx(v)
        return _found(e, path, "manifest") if e else None
    part = data.get("package" if kind == "cargo.toml" else "project")
    part = part if isinstance(part, dict) else {}
    v = part.get("license")
    if isinstance(v, str) and (e := spdx(v)):
        return _found(e, path, "manifest" if kind == "cargo.toml" else "manifest_nonstandard")
    if kind == "cargo.toml":
        f = part.get("license-file")
        return _referenced(f, root) if isinstance(f, str) else None
    if isinstance(v, dict):
        t, f = v.get("text"), v.get("file")
        if isinstance(t, str) and (e := match_text(t) or spdx(t)):
            return _found(e, path, "manifest")
        if isinstance(f, str):
            return _referenced(f, root)
    x = part.get("license-expression")
    return _found(e, path, "manifest") if isinstance(x, str) and (e := spdx(x)) else None


def from_manifests(root: dict[str, tuple[str, str]]) -> dict | None:
    for kind, read in (("package.json", json.loads), ("cargo.toml", tomllib.loads), ("pyproject.toml", tomllib.loads)):
        if kind in root:
            try:
                data = read(root[kind][1])
            except ValueError:
                continue
            hit = _declared(data, kind, root[kind][0], root) if isinstance(data, dict) else None
            if hit:
                return hit
    return None


def from_files(root: dict[str, tuple[str, str]]) -> dict | None:
    for name in _FILES:
        if name in root and (e := match_text(root[name][1][:TEXT_BYTES])):
            return _found(e, root[name][0], "anchor_match", _normal(root[name][1][:TEXT_BYTES]))
    return None


def _cc_name(name: str) -> str | None:
    base = re.sub(r"(?i)\.(?:txt|md|rst|html|htm|license)$", "", name.strip()).upper().replace("_", "-")
    return next((i for i in CC_IDS if i.upper() == base), None)


def content_notice(files: dict[str, str], root: dict[str, tuple[str, str]]) -> dict | None:
    """A Creative Commons licence of the content, by files in a licenses folder or a link in the readme."""
    named = []
    for path, text in files.items():
        low = path.lower().split("/")
        if "licenses" in low and (e := _cc_name(path.rpartition("/")[2])):
            named.append((low[0] != "licenses", path, e, text))
    for nested, path, e, text in sorted(named, key=lambda x: x[0]):
        return _found(e, path, "reuse_license", _normal(text), content_scope="subtree" if nested else "repo", content_license_url=f"https://{CC_PATHS[e]}")
    for name, (path, text) in root.items():
        low = text.lower()
        if name.startswith(("readme", "about")) and "creative commons" in low:
            for m in _CC_URL.finditer(text):
                e = next((i for i, p in CC_PATHS.items() if p in m[0].lower()), None)
                if e:
                    line = text[text.rfind("\n", 0, m.start()) + 1 :].partition("\n")[0].strip()
                    scope = "repo" if any(p in low for p in _SCOPES) else "partial"
                    return _found(e, path, "readme_cc", content_scope=scope, content_license_url=m[0], content_attribution_hint=line)
    return None


def detect(files: dict[str, str]) -> dict:
    """The licence of a tree, given path -> text: headers, then manifests, then licence files, then a notice for the whole repository."""
    files = {p: files[p] for p in sorted(files, key=str.casefold)}
    root = {p.lower(): (p, t) for p, t in files.items() if "/" not in p}
    content = content_notice(files, root)
    hit = from_headers(files) or from_manifests(root) or from_files(root)
    if hit is None:
        return content if content and content["content_scope"] == "repo" else {}
    if content and content["license"] != hit["license"]:
        hit |= {"content_license_id": content["license"], "content_license_path": content["license_path"], "content_license_detect_method": content["detect_method"], "content_license_sha256": content["license_sha256"], "content_scope": content["content_scope"], "content_license_url": content["content_license_url"]}
    return hit


FIELDS = ("license", "license_path", "detect_method", "license_sha256", "content_license_id", "content_license_path", "content_license_detect_method", "content_license_sha256", "content_scope", "content_license_url", "content_attribution_hint")


def by_repository(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "text") -> DataFrame:
    """A row of FIELDS for each repository.  Only files that detection can use, and only their heads, are shuffled."""
    p, t = F.col(path), F.substring(F.col(text), 1, TEXT_BYTES)
    useful = ~p.contains("/") | F.lower(p).rlike(r"(?:^|/)licenses/") | t.rlike("(?i)SPDX-License-Identifier:")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = detect(dict(zip(pdf["p"], pdf["t"], strict=True)))
        return pd.DataFrame([{"repo": pdf["r"].iloc[0], **{f: hit.get(f) for f in FIELDS}}], columns=["repo", *FIELDS])

    rows = files.where(p.isNotNull() & F.col(text).isNotNull() & useful).select(F.col(repo).cast("string").alias("r"), p.alias("p"), t.alias("t"))
    return rows.groupBy("r").applyInPandas(run, "repo string, " + ", ".join(f"{f} string" for f in FIELDS))


@F.pandas_udf(StringType())
def spdx_column(expressions: pd.Series) -> pd.Series:
    return expressions.map(lambda e: None if e is None else spdx(e))


@F.pandas_udf(StringType())
def match_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else match_text(t))
