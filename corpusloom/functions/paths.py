"""Paths, names and URLs: kinds, languages, sanitising, all as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANG = {
    "bash": "sh bash", "batch": "bat cmd", "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "csharp": "cs", "go": "go", "ini": "cfg ini", "java": "java",
    "javascript": "cjs js jsx mjs", "json": "json jsonc", "julia": "jl", "kotlin": "kt kts", "log": "log", "lua": "lua", "ndjson": "ndjson", "perl": "pl pm",
    "powershell": "ps1 psd1 psm1", "php": "php", "python": "ipynb py", "r": "r", "ruby": "rb", "rust": "rs", "scala": "scala", "sigma": "sigma", "sparql": "sparql",
    "sql": "sql", "swift": "swift", "toml": "toml", "typescript": "ts tsx", "windows-eventlog": "evtx", "xml": "xml xslt", "yaml": "yaml yml", "yara": "yar yara", "zsh": "zsh",
}
_DOC = {"markdown": "markdown md mdx", "restructuredtext": "rst", "asciidoc": "adoc", "text": "txt"}
_FORMAT = {"text": "text", "markdown": "md", "asciidoc": "asciidoc", "restructuredtext": "rst"}

LANG_OF = {f".{e}": lang for d in (_LANG, _DOC) for lang, exts in d.items() for e in exts.split()}
DOC_EXTS = {f".{e}" for exts in _DOC.values() for e in exts.split()}
CODE_EXTS = set(LANG_OF) - DOC_EXTS | {".py3", ".pyw"}
FORMAT_OF = {e: _FORMAT[LANG_OF[e]] for e in DOC_EXTS}
_NAMES = {"cmake": "cmakelists.txt", "docker": "dockerfile", "json": "package-lock.json package.json", "makefile": "makefile", "python": "poetry.lock requirements.txt", "ruby": "gemfile", "yaml": "docker-compose.yaml docker-compose.yml"}
SPECIAL = {n: lang for lang, names in _NAMES.items() for n in names.split()}
_INTERPRETERS = {"bash": "bash sh", "javascript": "deno node nodejs", "php": "php", "lua": "lua", "python": "python python2 python3", "perl": "perl", "r": "rscript", "zsh": "zsh", "ruby": "ruby"}
INTERPRETER_OF = {n: lang for lang, names in _INTERPRETERS.items() for n in names.split()}
_ODD_NAMES = {"csharp": "C#", "asciidoc": "AsciiDoc", "cpp": "C++", "javascript": "JavaScript", "typescript": "TypeScript", "powershell": "PowerShell", "php": "PHP", "restructuredtext": "reStructuredText", "windows-eventlog": "Windows Event Log", **{n: n.upper() for n in ("sql", "sparql", "json", "yaml", "toml", "ini", "xml", "yara", "ndjson")}}
DISPLAY = {lang: _ODD_NAMES.get(lang, lang.capitalize()) for lang in sorted(set(LANG_OF.values()))}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    """The part after the last slash; slashes at the end don't count."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def path_suffix(path: Column) -> Column:
    """Extension in lower case with its dot; '' for names without one and for dot files.  A row mark like x.csv:#2 is taken off first."""
    name = F.regexp_replace(base_name(path), r":#\d+$", "")
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def lang_hint(path: Column) -> Column:
    """struct(kind, lang) from a path: special names first, then the extension; an unknown one names itself."""
    name, ext = F.lower(base_name(path)), path_suffix(path)
    special = F.try_element_at(_map(SPECIAL), name)
    kind = F.when(special.isNotNull() | ext.isin(*sorted(CODE_EXTS)), "code").otherwise("doc")
    fallback = F.when(ext != "", F.substr(ext, F.lit(2))).otherwise("text")
    return F.struct(kind.alias("kind"), F.coalesce(special, F.try_element_at(_map(LANG_OF), ext), fallback).alias("lang"))


def path_kind(path: Column) -> Column:
    """struct(kind, hint): documentation by its extension before special names; hint is null for unknown ones."""
    ext, guess = path_suffix(path), lang_hint(path)
    doc = ext.isin(*sorted(DOC_EXTS))
    kind = F.when(doc, "doc").otherwise(guess["kind"])
    return F.struct(kind.alias("kind"), F.when(doc | (guess["kind"] == "doc"), F.try_element_at(_map(FORMAT_OF), ext)).otherwise(guess["lang"]).alias("hint"))


def display_lang(hint: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DISPLAY), hint), F.concat(F.upper(F.substring(hint, 1, 1)), F.lower(F.substr(hint, F.lit(2)))), F.lit("Text"))


def shebang_lang(text: Column) -> Column:
    """Language of the interpreter on a '#!' line, also through env."""
    first = F.trim(F.regexp_extract(text, r"^([^\n\r]*)", 1))
    argv = F.split(F.trim(F.substr(first, F.lit(3))), r"\s+")
    name = F.lower(F.regexp_extract(argv[0], "([^/]*)$", 1))
    name = F.when((name == "env") & (F.size(argv) > 1), F.lower(F.try_element_at(argv, F.lit(2)))).otherwise(name)
    return F.when(first.startswith("#!"), F.try_element_at(_map(INTERPRETER_OF), name))


def code_lang(text: Column, path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SPECIAL), F.lower(base_name(path))), F.try_element_at(_map(LANG_OF), path_suffix(path)), shebang_lang(text))


def sanitize_url(url: Column) -> Column:
    """An http(s) URL without user, query and fragment; others null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#@]+)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), F.lower(host), path))


def url_domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)", 1))
    return F.when(host != "", host)


_NAME = r"([A-Za-z0-9_.-]+)"


def repo_spec(url: Column) -> Column:
    """struct(owner, repo, ref, subpath) of a repository's web, tree, blob, .git or ssh address; null for others."""
    pattern = rf"^(?:https?://(?:www\.)?github\.com/|git@github\.com:|ssh://git@github\.com/){_NAME}/([A-Za-z0-9_.-]+?)(?:\.git)?(?:/(?:tree|blob)/([^/?#]+)(?:/([^?#]*))?)?/?(?:[?#].*)?$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim(url), pattern, k), F.lit(""))
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("ref"), F.nullif(F.regexp_replace(part(4), "/+$", ""), F.lit("")).alias("subpath")))


def clean_label(path: Column, fallback: Column) -> Column:
    """A relative path without '..', '.', control characters and backslashes; fallback where nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(slashes(path), r"[\x00-\x1F\x7F]", ""), "/"), lambda p: ~F.trim(p).isin("", ".", ".."))
    return F.coalesce(F.nullif(F.array_join(F.transform(parts, F.trim), "/"), F.lit("")), fallback)


def normalize_exts(exts) -> list[str] | None:
    """Trimmed, lower-case extensions with a dot; None if there is none."""
    found = sorted({e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in exts or ()) if e})
    return found or None


_WINDOWS = {*"aux con nul prn".split(), *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}


def safe_name(*pieces: str | None, most: int = 120) -> str:
    """File name of the pieces, joined by two underscores."""
    kept = [re.sub(r"[^\w.-]+", "_", p.strip(), flags=re.A).strip("._-") for p in pieces if p and p.strip()]
    name = "__".join(p for p in kept if p)[:most].rstrip("._-") or "output"
    return f"_{name}" if name.split(".")[0].lower() in _WINDOWS else name
