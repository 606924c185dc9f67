"""Known values of the formulas."""

import pytest
from pyspark.sql import functions as F

from thriftline.functions import commands as c
from thriftline.functions import errors, numbers, text
from thriftline.operators import corrections, economics, telemetry


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first().asDict()


def usage(spark, i, o, cw, cr, cost, saved):
    names = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "total_cost", "saved_tokens"]
    return spark.createDataFrame([(i, o, cw, cr, i + o + cw + cr, float(cost), saved)], "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, total_tokens long, total_cost double, saved_tokens long").select(*names)


def test_weighted_cost(spark):
    r = economics.weighted(usage(spark, 1000, 500, 200, 5000, 100, 10_000)).first()
    assert r.weighted_units == pytest.approx(4250) and r.weighted_savings == pytest.approx(10_000 * 100 / 4250)
    r = economics.weighted(usage(spark, 0, 0, 0, 0, 5, 10)).first()
    assert r.weighted_cpt is None and r.weighted_savings is None


def test_dual_cost(spark):
    r = economics.dual(usage(spark, 1000, 1000, 0, 0, 60, 3000)).first()
    assert r.blended_savings == pytest.approx(90) and economics.dual(usage(spark, 0, 0, 0, 0, 1, 1)).first().active_cpt is None


def test_tokens_and_savings(spark):
    got = [one(spark, x=numbers.estimate_tokens(F.lit(s)))["x"] for s in ("", "abcd", "abcde", "abcdefghijk")]
    assert got == [0, 1, 2, 3]
    saved, pct = numbers.compare_savings(F.lit(1000), F.lit(300))
    assert one(spark, s=saved, p=pct) == {"s": 700, "p": 70.0}
    saved, pct = numbers.compare_savings(F.lit(100), F.lit(150))
    assert one(spark, s=saved, p=pct) == {"s": 0, "p": 0.0}


def test_base_commands(spark):
    r = one(
        spark, a=c.base_command_after_env(F.lit("NODE_ENV=test CI=1 npx vitest")), b=c.base_command(F.lit("sudo X=1 git commit --amend")),
        d=c.base_command_discover(F.lit("ls -la")), e=c.base_command_discover(F.lit("make all x")), f=c.unwrap_runner(F.lit("mise exec -- just -- pytest -q")),
    )
    assert r == {"a": "npx vitest", "b": "git commit", "d": "ls", "e": "make all", "f": "pytest -q"}


def test_similarity_and_changed_token(spark):
    sim = c.tokens_similarity(F.lit("git commit --amed"), F.lit("git commit --amend"))
    assert one(spark, s=sim, d=c.changed_token(F.lit("git commit --amed"), F.lit("git commit --amend"))) == {"s": 0.5, "d": "--amed → --amend"}
    assert one(spark, s=c.tokens_similarity(F.lit("git log"), F.lit("git log")))["s"] == 1.0
    assert one(spark, s=c.tokens_similarity(F.lit("A=1 git log x"), F.lit("git diff x")))["s"] == 0.0


@pytest.mark.parametrize(
    ("text_", "parts"),
    [("a && b", ["a", "b"]), ("a; b || c", ["a", "b", "c"]), ("a | b && c", ["a | b && c"]), ("echo 'x;y' ; z", ["echo 'x;y'", "z"]), ("cat <<E && x", ["cat <<E && x"]), (r"a \; b; c", [r"a \; b", "c"]), (r'''echo "x\";y" && z''', [r'''echo "x\";y"''', "z"]), (r"echo '\' ; z", [r"echo '\'", "z"]), ("", []), (" ; ", [])],
)
def test_split_chain(text_, parts):
    assert c.split_chain_text(text_) == parts


def calls(spark, *rows):
    return spark.createDataFrame([("s", i, cmd, err, out) for i, (cmd, err, out) in enumerate(rows)], "session_id string, sequence_index long, command string, is_error boolean, output_content string")


BAD = "error: unexpected argument '--amed'"


def test_correction_confidence(spark):
    r = corrections.corrections(calls(spark, ("git commit --amed", True, BAD), ("git commit --amend", False, "ok"))).collect()
    assert [(x.wrong_command, x.right_command, x.confidence, x.error_class) for x in r] == [("git commit --amed", "git commit --amend", 0.7, "Unknown Flag")]


def test_correction_window_and_cycles(spark):
    late = [("git commit --amed", True, BAD), *[("ls", False, "ok")] * 3, ("git commit --amend", False, "ok")]
    assert corrections.corrections(calls(spark, *late)).count() == 0
    cycle = [("cargo build a", True, "error[E0308]: mismatched"), ("cargo build b", False, "ok")]
    assert corrections.corrections(calls(spark, *cycle)).count() == 0


def test_refused_commands_are_no_errors(spark):
    assert one(spark, x=errors.is_command_error(F.lit(True), F.lit("Error: User declined")))["x"] is False


def test_quality_score_stays_in_range(spark):
    assert one(spark, a=telemetry.quality_score(F.lit(100.0), F.lit(100.0)), b=telemetry.quality_score(F.lit(50.0), F.lit(0.0))) == {"a": 100.0, "b": 35.0}


def test_project_scope_takes_characters_literally(spark):
    df = spark.createDataFrame([("/a*",), ("/a*/b",), ("/ab",), (None,)], "project_path string")
    assert sorted(r[0] for r in telemetry.in_project(df, "/a*").collect()) == ["/a*", "/a*/b"]
    with pytest.raises(ValueError, match="more than one"):
        telemetry.find_project(df, "A")


def test_text_functions(spark):
    r = one(
        spark, n=text.normalised_log_line(F.lit("2024-01-01 10:00:00 ERROR at /usr/x 0xFF 12345 123")), a=text.adaptive_level(F.lit(501), F.lit(6)), j=text.content_type(F.lit('{"a": 1}')),
        s=text.content_type(F.lit("a: 1\nb: 2")), m=text.masked(F.lit("API_KEY"), F.lit("abcdef")), x=text.strip_ansi(F.lit("\x1b[31mred\x1b[0m")),
    )
    assert r == {"n": "ERROR at <PATH> <HEX> <NUM> 123", "a": "light", "j": "json", "s": "structured", "m": "ab****ef", "x": "red"}
