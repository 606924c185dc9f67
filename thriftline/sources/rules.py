"""The classification rules of shell commands, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_JS = r"^(npx\s+|pnpm\s+|bunx\s+|bun\s+run\s+|yarn\s+exec\s+|yarn\s+dlx\s+|pnpm\s+exec\s+|pnpm\s+dlx\s+)?"
_SKIP = {s: "passthrough" for s in ("checkout", "switch", "restore", "reset", "cherry-pick", "clone", "remote", "tag")}

#: Pattern, target, category, saving in percent, savings of subcommands (group 1 of the pattern), status of subcommands.
#: Of several that match, the last counts.
RULES = (
    (r"^git\s+(status|log|diff|show|add|commit|push|pull|branch|fetch|stash|worktree|rebase|merge|checkout|switch|restore|reset|cherry-pick|tag|remote|clone)", "git", "Git", 70.0, {"diff": 80.0, "show": 80.0, "add": 59.0, "commit": 59.0}, _SKIP),
    (r"^gh\s+(pr|issue|run|repo|api|release)", "gh", "GitHub", 82.0, {"pr": 87.0, "run": 82.0, "issue": 80.0}, {}),
    (r"^cargo\s+(build|test|clippy|check|fmt|install|nextest)", "cargo", "Cargo", 80.0, {"test": 90.0, "nextest": 90.0, "check": 80.0}, {"fmt": "passthrough"}),
    (r"^pnpm\s+(list|ls|outdated|install)", "pnpm", "PackageManager", 80.0, {}, {}),
    (r"^npm\s+(run|exec)", "npm", "PackageManager", 70.0, {}, {}),
    (r"^npx\s+", "npx", "PackageManager", 70.0, {}, {}),
    (r"^(cat|head|tail)\s+", "read", "Files", 60.0, {}, {}),
    (r"^(rg|grep|egrep|fgrep)\s+", "grep", "Files", 75.0, {}, {}),
    (r"^ls(\s|$)", "ls", "Files", 65.0, {}, {}),
    (r"^find\s+", "find", "Files", 70.0, {}, {}),
    (_JS + r"tsc(\s|$)", "tsc", "Build", 83.0, {}, {}),
    (_JS + r"(eslint|biome|lint)(\s|$)", "lint", "Build", 84.0, {}, {}),
    (_JS + "prettier", "prettier", "Build", 70.0, {}, {}),
    (_JS + r"next\s+build", "next", "Build", 87.0, {}, {}),
    (_JS + r"(vitest|jest|test)(\s|$)", "vitest", "Tests", 99.0, {}, {}),
    (_JS + "playwright", "playwright", "Tests", 94.0, {}, {}),
    (_JS + "prisma", "prisma", "Build", 88.0, {}, {}),
    (r"^(docker|podman)\s+(ps|images|logs|run|exec|build|compose\s+(ps|logs|build))", "docker", "Infra", 85.0, {}, {}),
    (r"^kubectl\s+(get|logs|describe|apply)", "kubectl", "Infra", 85.0, {}, {}),
    (r"^tree(\s|$)", "tree", "Files", 70.0, {}, {}),
    (r"^diff\s+", "diff", "Files", 60.0, {}, {}),
    (r"^diffsitter\s+", "diff", "Files", 60.0, {}, {}),
    (r"^curl\s+", "curl", "Network", 70.0, {}, {}),
    (r"^wget\s+", "wget", "Network", 65.0, {}, {}),
    (r"^(python3?\s+-m\s+)?mypy(\s|$)", "mypy", "Build", 80.0, {}, {}),
    (r"^ruff\s+(check|format)", "ruff", "Python", 80.0, {"check": 80.0, "format": 75.0}, {}),
    (r"^(python3?\s+-m\s+)?pytest(\s|$)", "pytest", "Python", 90.0, {}, {}),
    (r"^(python3?\s+-m\s+)?(pip3?|uv\s+pip)\s+(list|outdated|install)", "pip", "Python", 75.0, {"list": 75.0, "outdated": 80.0}, {}),
    (r"^go\s+(test|build|vet)", "go", "Go", 85.0, {"test": 90.0, "build": 80.0, "vet": 75.0}, {}),
    (r"^golangci-lint(\s|$)", "golangci-lint", "Go", 85.0, {}, {}),
    (r"^aws\s+", "aws", "Infra", 80.0, {}, {}),
    (r"^psql(\s|$)", "psql", "Infra", 75.0, {}, {}),
    (r"^(terraform|tofu|opentofu)\s+(plan|apply|init|show|output|destroy|validate|fmt)", "terraform", "Infra", 75.0, {"plan": 80.0, "apply": 85.0}, {}),
    (r"^atmos\s+(terraform|describe|validate|workflow|version)", "atmos", "Infra", 75.0, {"terraform": 80.0, "describe": 70.0}, {}),
)

#: Commands that are not looked at, whole and by their start.
IGNORED_EXACT = ("cd", "echo", "true", "false", "wait", "pwd", "bash", "sh", "fi", "done")
IGNORED_PREFIXES = (
    "cd ", "cd\t", "echo ", "printf ", "export ", "source ", "mkdir ", "rm ", "mv ", "cp ", "chmod ", "chown ", "touch ", "which ", "type ", "command ", "test ",
    "true", "false", "sleep ", "wait", "kill ", "set ", "unset ", "wc ", "sort ", "uniq ", "tr ", "cut ", "awk ", "sed ", "python3 -c", "python -c", "node -e", "ruby -e",
    "pwd", "bash ", "sh ", "then\n", "then ", "else\n", "else ", "do\n", "do ", "for ", "while ", "if ", "case ",
)

#: Tokens of an output whose length is not known, by category and by subcommand.
CATEGORY_TOKENS = {"Git": 40, "Cargo": 150, "Tests": 800, "Files": 100, "Build": 300, "Infra": 120, "Network": 150, "GitHub": 200, "PackageManager": 150}
SUBCOMMAND_TOKENS = {("Git", "log"): 200, ("Git", "diff"): 200, ("Git", "show"): 200, ("Cargo", "test"): 500}
DEFAULT_TOKENS = 150


def rule_table(spark: SparkSession) -> DataFrame:
    """classification_rules: idx, pattern, target, category, savings_pct, subcmd_savings, subcmd_status."""
    def mapped(m: dict, kind: str):
        return F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).cast(f"map<string,{kind}>") if m else F.expr(f"cast(map() as map<string,{kind}>)")

    rows = [
        F.struct(F.lit(i).alias("idx"), F.lit(p).alias("pattern"), F.lit(t).alias("target"), F.lit(c).alias("category"), F.lit(pct).alias("savings_pct"), mapped(s, "double").alias("subcmd_savings"), mapped(st, "string").alias("subcmd_status"))
        for i, (p, t, c, pct, s, st) in enumerate(RULES)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
