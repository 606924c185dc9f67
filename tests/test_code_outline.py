"""Outlines of source files by rule, and by brute force on files made of known parts."""

import random

import pytest

from thriftline.operators import outline as op
from thriftline.operators.outline import aggressive, minimal


def test_short_comments_above_the_code_stay_and_licences_go():
    assert minimal('// This is a comment\nfn main() {\n    println!("Hello");\n}\n', "rust") == '// This is a comment\nfn main() {\n    println!("Hello");\n}'
    licence = "".join(f"// line {i}\n" for i in range(4))
    assert minimal(licence + "fn main() {}\n", "rust") == "fn main() {}"
    assert minimal(licence + "\nfn main() {}\n", "rust") == "fn main() {}"
    assert minimal("// a\n// b\n// c\n", "rust") == "// a\n// b\n// c" and minimal(licence, "rust") == ""


def test_noise_goes_and_other_comments_stay():
    code = "fn foo() {\n    // ========================\n    // TODO: fix this\n    // eslint-disable-next-line\n    let x = 1;\n}\n"
    assert minimal(code, "rust") == "fn foo() {\n    // TODO: fix this\n    let x = 1;\n}"
    assert minimal("x = 1\n# type: ignore\n# plain\n", "python") == "x = 1\n# plain"


def test_doc_comments_stay_in_front_of_the_code():
    licence = "".join(f"// line {i}\n" for i in range(4))
    assert minimal(licence + "/// doc\npub struct A {\n}\n", "rust") == "/// doc\npub struct A {\n}"
    assert minimal("//! crate\nfn a() {}\n", "rust") == "//! crate\nfn a() {}"


def test_blocks():
    assert minimal("int a;\n/* ---- */\n/*\n * ====\n */\n/* said\n   here */\nint b;\n", "c") == "int a;\n/* said\n   here */\nint b;"
    assert minimal("x\n=begin\nsaid\n=end\ny\n", "ruby") == "x\n=begin\nsaid\n=end\ny"
    assert minimal("/** doc\n * more\n */\nint a;\n", "java") == "/** doc\n * more\n */\nint a;"
    assert minimal('def f():\n    """One.\n\n\n\n    # kept\n    """\n    return 1\n', "python") == 'def f():\n    """One.\n\n    # kept\n    """\n    return 1'


@pytest.mark.parametrize("lang", ["rust", "javascript", "typescript", "go", "c", "cpp", "java", "unknown"])
def test_marks_in_strings_open_no_comment(lang):
    code = 'a = "/*";\nb = "\\"/*";\nc = `x/*`;\nd = "// no";\n'
    assert minimal(code, lang) == code.strip()


def test_blank_runs_and_line_ends():
    assert minimal("a\r\n\r\n\r\n\r\nb\r\n", "go") == "a\n\nb"
    assert minimal("", "go") == "" == aggressive("", "go") and minimal("\n\n", "go") == ""


def test_bodies_collapse_beyond_thirty_lines():
    for n in (28, 29):
        body = "  if x {\n" + "    y;\n" * n + "  }\n"
        got = aggressive(f"use a;\npub fn f() {{\n{body}}}\nlet z = 1;\nz += 1;\n", "rust")
        assert got == "use a;\npub fn f() {\n" + (body if n == 28 else f"    // ... ({n + 2} lines)\n") + "let z = 1;"


def test_languages_by_extension():
    assert [op.language_of(e) for e in ("rs", "PY", "mjs", "tsx", "go", "h", "hpp", "java", "rb", "zsh", "txt", None)] == ["rust", "python", "javascript", "typescript", "go", "c", "cpp", "java", "ruby", "shell", "unknown", "unknown"]


def test_files_of_known_parts(spark):
    """Parts whose outline is known, in any order, after a line of code."""
    rng, rows, want = random.Random(2), [], {}
    parts = [("import a", "import a", "import a"), ("// ----", None, None), ("// said", "// said", None), ("/* one\n two */", "/* one\n two */", None), ("x = \"/*\"", "x = \"/*\"", None), ("let y = 1", "let y = 1", "let y = 1")]
    for i in range(60):
        picked = rng.choices(parts, k=rng.randrange(30))
        rows.append((i, "rs", "\n".join(["code", *[p[0] for p in picked]])))
        want[i] = ("\n".join(["code", *[p[1] for p in picked if p[1]]]), "\n".join(p[2] for p in picked if p[2]))
    rows += [(60, None, None), (61, "rs", "")]
    want |= {60: (None, None), 61: ("", "")}
    files = spark.createDataFrame(rows, "output_id long, ext string, text string").repartition(3)
    for at, level in enumerate(("minimal", "aggressive")):
        assert {r.output_id: r.outline for r in op.code_outline(files, level).collect()} == {k: v[at] for k, v in want.items()}
    assert op.code_outline(files.limit(0)).count() == 0
