"""Outlines of source files (output_id, ext, text): what a reader needs of the code, by level.

minimal drops the licence above the code, separators, generated marks and lint
directives; aggressive keeps of that the imports, signatures and constants, and
of the bodies below signatures those that are short.

A file is one text; its lines are read once by a small state machine in an
Arrow-batched function. Text in double or back quotes on a line is no comment mark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension, their comment marks (line, block start, block end, doc line, doc block), what makes
#: a comment noise, how imports, signatures and constants begin, and the limits.
EXTENSIONS = {
    "rust": "rs", "python": "py pyw", "javascript": "js mjs cjs", "typescript": "ts tsx", "go": "go", "c": "c h", "cpp": "cpp cc cxx hpp hh", "java": "java", "ruby": "rb", "shell": "sh bash zsh",
}
SLASHES = ("//", "/*", "*/", None, "/**")
COMMENTS = {
    "rust": ("//", "/*", "*/", "///", "/**"), "python": ("#", '"""', '"""', None, '"""'), **dict.fromkeys(("javascript", "typescript", "go", "c", "cpp", "java"), SLASHES),
    "ruby": ("#", "=begin", "=end", None, None), "shell": ("#", None, None, None, None), "unknown": ("//", "/*", "*/", None, None),
}
NOISE = ("Code generated", "DO NOT EDIT", "@generated", "AUTO-GENERATED", "eslint-disable", "type: ignore", "nolint", "#pragma")
IMPORT = re.compile(r"^(use |import |from |require\(|#include)")
SIGNATURE = re.compile(r"^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+")
CONSTANTS = ("const ", "static ", "let ", "pub const ", "pub static ")
PREAMBLE_LINES, BODY_LINES = 3, 30

_separator = re.compile(r"[/#=\-*~ \t]*")
_quoted = re.compile(r'"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`')


def language_of(ext: str | None) -> str:
    return next((lang for lang, exts in EXTENSIONS.items() if (ext or "").lower() in exts.split()), "unknown")


def is_noise(comment: str) -> bool:
    said = comment.strip()
    return len(said) > 3 and bool(_separator.fullmatch(said)) or any(mark in said for mark in NOISE)


def bare(line: str) -> str:
    """line without the marks of a block comment."""
    line = line.strip()
    for mark in ("/**", "/*"):
        while line.startswith(mark):
            line = line[len(mark) :]
    while line.endswith("*/"):
        line = line[:-2]
    return line.lstrip("*").strip()


@dataclass
class Marks:
    line: str | None
    start: str | None
    end: str | None
    doc_line: str | None
    doc_start: str | None

    def opens_block(self, said: str) -> bool:
        unquoted = said if self.start == '"""' else _quoted.sub('""', said)
        return bool(self.start) and self.start in unquoted and not said.startswith(self.doc_start or "###")


class _Preamble:
    """Lines before the first line of code; comments of more than PREAMBLE_LINES lines in a row are a licence and go."""

    def __init__(self):
        self.held: list[str] = []
        self.over = False

    def release(self, out: list[str]) -> None:
        if len(self.held) <= PREAMBLE_LINES:
            out += self.held
        self.held = []


def lines_of(text: str) -> list[str]:
    lines = [line.removesuffix("\r") for line in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def minimal(text: str, lang: str) -> str:
    marks, out, before, block, in_doc = Marks(*COMMENTS[lang]), [], _Preamble(), None, False
    for line in lines_of(text):
        said = line.strip()
        if block is None and not in_doc and marks.opens_block(said):
            block = []
        if block is not None:
            block.append(line)
            if marks.end in said:
                if not all(not bare(b) or is_noise(bare(b)) or is_noise(b) for b in block):
                    (out if before.over else before.held).extend(block)
                block = None
        elif lang == "python" and said.startswith('"""'):
            in_doc = not in_doc
            out.append(line)
        elif in_doc:
            out.append(line)
        elif marks.line and said.startswith(marks.line):
            if marks.doc_line and said.startswith(marks.doc_line) or lang == "rust" and said.startswith("//!"):
                out.append(line)
            elif not before.over:
                before.held.append(line)
            elif not is_noise(said):
                out.append(line)
        elif not said:
            if not before.over:
                before.release(out)
            out.append("")
        else:
            if not before.over:
                before.release(out)
                before.over = True
            out.append(line)
    if not before.over:
        before.release(out)
    return re.sub(r"\n{3,}", "\n\n", "".join(f"{line}\n" for line in out)).strip()


def aggressive(text: str, lang: str) -> str:
    out, body, depth = [], None, 0
    for line in minimal(text, lang).split("\n"):
        said = line.strip()
        if IMPORT.match(said):
            out.append(line)
        elif SIGNATURE.match(said):
            out.append(line)
            body, depth = [], 0
        elif body is not None:
            depth += said.count("{") - said.count("}")
            body.append(line)
            if depth <= 0:
                out += body if len(body) <= BODY_LINES else [f"    // ... ({len(body)} lines)"]
                body = None
        elif said.startswith(CONSTANTS):
            out.append(line)
    return "\n".join(out).strip()


LEVELS = {"none": lambda text, lang: text, "minimal": minimal, "aggressive": aggressive}


def outlined(ext: Column, text: Column, level: str = "minimal") -> Column:
    """text cut to level by the language of ext; null stays null, an unknown extension has comments of // and /*."""
    cut = LEVELS[level]

    @F.pandas_udf("string")
    def apply(exts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, language_of(e)) for e, t in zip(exts, texts)], dtype=object)

    return apply(ext, text)


def code_outline(files: DataFrame, level: str = "minimal") -> DataFrame:
    """files (output_id, ext, text) with `outline`, and how many lines a text has and its outline keeps."""
    lines = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "\n"))).cast("long")
    out = files.withColumn("outline", outlined(F.col("ext"), F.col("text"), level))
    return out.withColumn("lines", lines(F.regexp_replace("text", r"\n\z", ""))).withColumn("kept_lines", lines(F.col("outline")))
