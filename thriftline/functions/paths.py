"""Expressions over paths, environment variables and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages of file extensions.
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyw"), "javascript": ("js", "mjs", "cjs"), "typescript": ("ts", "tsx"), "go": ("go",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh"), "java": ("java",), "ruby": ("rb",), "shell": ("sh", "bash", "zsh"),
}
#: Words of variables of a kind, tried in this order after PATH.
VARIABLE_KINDS = {
    "language": ("RUST", "CARGO", "PYTHON", "PIP", "NODE", "NPM", "YARN", "DENO", "BUN", "JAVA", "MAVEN", "GRADLE", "GO", "RUBY", "GEM", "PERL", "PHP", "DOTNET", "NUGET"),
    "cloud": ("AWS", "AZURE", "GCP", "GOOGLE_CLOUD", "DOCKER", "KUBERNETES", "K8S", "HELM", "TERRAFORM", "VAULT", "CONSUL", "NOMAD"),
    "tool": ("EDITOR", "VISUAL", "SHELL", "TERM", "GIT", "SSH", "GPG", "BREW", "XDG"),
}
#: Names in listings that are no content.
NOISE_NAMES = (
    "node_modules", ".git", "target", "__pycache__", ".next", ".cache", ".turbo", ".vercel", ".pytest_cache", ".mypy_cache", ".tox",
    ".venv", "venv", "coverage", ".nyc_output", ".DS_Store", "Thumbs.db", ".idea", ".vs", "*.egg-info", ".eggs",
)


def language(path: Column) -> Column:
    """Of a file by its extension, else unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def compact_path(path: Column) -> Column:
    """From the last src/, lib/ or tests/ on, in this order, else the last component."""
    p = F.translate(path, "\\", "/")
    out = F.element_at(F.split(p, "/"), -1)
    for folder in ("tests", "lib", "src"):
        out = F.when(p.contains(f"/{folder}/"), F.concat(F.lit(f"{folder}/"), F.substring_index(p, f"/{folder}/", -1))).otherwise(out)
    return out


def shorten_path(path: Column) -> Column:
    """Only the last two components where there are over four; a root counts as one."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    root = path.startswith("/")
    tail = F.array_join(F.slice(parts, -2, 2), "/")
    return F.when(F.size(parts) + root.cast("int") <= 4, path).otherwise(F.concat(F.when(root, "/.../").otherwise(".../"), tail))


def glob_match(pattern: str, name: Column, ignore_case: bool = False) -> Column:
    """Whether a whole name fits a pattern of * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return name.rlike(f"(?s{'i' if ignore_case else ''})^{body}\\z")


def variable_kind(key: Column) -> Column:
    up = F.upper(key)
    out = F.lit("other")
    for kind, words in reversed(VARIABLE_KINDS.items()):
        out = F.when(up.rlike("|".join(words)), kind).otherwise(out)
    return F.when(up.contains("PATH"), "path").otherwise(out)


def project_name(name: Column, remote: Column, path: Column) -> Column:
    """The given name, else the last part of the remote's url, else the folder."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(name), blank(F.regexp_extract(remote, r"([^/:]+?)(?:\.git)?/?$", 1)), blank(F.element_at(F.split(path, "/"), -1)))
