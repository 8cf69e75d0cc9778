"""Routing of inputs: features of a text, recommended tools with a confidence, risk flags and a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.predicates import folded, matches, matches_folded
from strataloom.functions.text import lines_of, round_to
from strataloom.session import spread

# Patterns of tasks and risks, each with all its alternatives. Word edges are ASCII, as everywhere here, so
# the Cyrillic alternatives between two edges only match where Latin letters touch them; that is the patterns' meaning.
URL = r"\bhttps?://[^\s<>)\"']+"
IMAGE = r"\.(png|jpe?g|webp|gif)(\?|#|$)"
RISKS = {
    "architecture_heavy": r"\b(architecture|архитектур|design doc|system design|schema migration)\b",
    "security_sensitive": r"\b(security|secret|credential|token|auth|permission|ssh|prod|production|deploy|infra)\b",
    "destructive_or_data_risk": r"\b(delete|remove all|reset|rollback|migration|truncate|drop|force-push|force push)\b",
    "final_output_sensitive": r"\b(final answer|final copy|publish|send to client|legal|medical|financial|contract)\b",
    "ambiguous_task": r"^(fix it|do it|сделай|исправь|почини)\s*$",
}
TASKS = {
    "trace": r"\btrace\.zip\b|\bhar\b|\bplaywright trace\b|\bconsole errors?\b|\bnetwork failures?\b",
    "deep_web": r"\bserp\b|\bcrawl\b|\bdeep research\b|\bextract structured\b|\binteract\b",
    "read": r"\b(read|summari[sz]e|compare|extract|parse|review|analy[sz]e)\b|\b(прочитай|суммируй|разбери|сравни|извлеки|проанализируй)\b",
    "repo": r"\b(where|which files|implemented|spans|codebase|repo|bug fix|refactor|review this branch)\b|\b(где|какие файлы|кодовой базе|репо|баг|рефактор|ветк)\b",
    "checks": r"\b(run|check)\s+(tests?|build|tsc|eslint|lint|typecheck)\b|\bproof loop\b",
    "release": r"\b(release hygiene|repo hygiene|repository hygiene|public repo(?:sitory)? file list|repo snapshot|synthetic repo snapshot)\b|\b(generated artifacts?|generated dist|tracked dist|missing license file|license file missing|public release blocker)\b",
    "dependency": r"\b(npm audit|osv|license|dependency|lockfile|supply chain|vulnerabilit)\b",
    "docs": r"\b(broken links?|stale refs?|frontmatter|docs hygiene|orphan docs?|notion mirror|docs sync)\b",
    "cleanup": r"\b(unused exports?|unused dependencies?|duplicate code|repo hygiene|cleanup plan)\b",
    "gate": r"\b(context pressure|quality gate|new code budget|new docs budget|large docs?)\b",
}
FILE_PATH = r"(^|\s)([\w.-]+/)+[\w.-]+\.(ts|tsx|js|jsx|mjs|cjs|py|md|mdx|json|yaml|yml|php|sh)(:\d+)?(\s|$)"


def route(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, tools, decision, risk_flags, score of each text."""
    rows = spread(rows.select(key, text)).select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    t, low = F.col("t"), F.col("low")
    rows = rows.withColumn("low", folded(t))
    seen = lambda x: matches_folded(t, low, x)
    n, lines = F.length(t), F.when(t == "", 0).otherwise(F.size(lines_of(t)))
    urls = F.transform(F.regexp_extract_all(t, F.lit("(?i)" + URL.replace(r"\b", "")), 0), lambda u: F.rtrim(u, F.lit("),.;")))
    images = F.exists(urls, lambda u: matches(u, IMAGE))
    pages = F.exists(urls, lambda u: ~matches(u, IMAGE))
    stack = (t.rlike(r":\d+:\d+\)") & t.rlike(r"(?m)^\s*at\s+.+\(.+:\d+:\d+\)")) | seen(r"traceback \(most recent call last\)") | seen(r"\berror:\s.+")
    # each is tested once, however often it is asked for
    facts = {"log": (lines >= 150) | (n >= 8000) | stack, "n": n, "images": images, "pages": pages, "file_path": t.contains("/") & matches(t, FILE_PATH), "has_url": F.size(urls) > 0}
    rows = rows.select(key, F.explode(F.array(F.struct(*(c.alias(k) for k, c in facts.items()), *(seen(p).alias(f"task_{k}") for k, p in TASKS.items()), *(seen(p).alias(f"risk_{k}") for k, p in RISKS.items())))).alias("f")).select(key, "f.*")
    log, n, images, pages, file_path = map(F.col, ("log", "n", "images", "pages", "file_path"))
    task = lambda name: F.col(f"task_{name}")
    pick = lambda cond, tool, sure: F.when(cond, F.struct(F.lit(tool).alias("tool"), F.lit(sure).alias("sure")))
    found = F.array_compact(
        F.array(
            pick(images, "screenshot", 0.96), pick(task("trace"), "trace", 0.94), pick(log, "logs", 0.93), pick(~log & (n >= 5000), "text", 0.9), pick(task("deep_web"), "scraper", 0.9),
            pick(~task("deep_web") & pages & task("read"), "url", 0.88), pick(task("repo") & ~file_path & ~log, "retrieval", 0.88), pick(task("checks"), "checks", 0.86),
            pick(task("dependency") & ~task("release"), "dependency", 0.88), pick(task("docs"), "docs", 0.84), pick(task("release") | task("cleanup"), "cleanup", 0.84), pick(task("gate"), "gate", 0.84),
        )
    )
    risks = F.array_compact(F.array(*(F.when(F.col(f"risk_{k}"), F.lit(k)) for k in RISKS)))
    out = rows.select(key, found.alias("found"), risks.alias("risks"), n, "has_url")
    decision = F.when(F.array_contains("risks", "ambiguous_task") & (F.size("found") == 0), "ask").when(F.size("found") > 0, "call").otherwise("skip")
    out = out.withColumn("decision", decision)
    best = F.greatest(F.lit(0.72), F.array_max(F.transform("found", lambda x: x["sure"])))
    score = F.when(F.col("decision") == "skip", F.when((F.col("n") < 1200) & ~F.col("has_url"), 0.82).otherwise(0.68)).otherwise(best)
    return out.select(key, F.array_join(F.transform("found", lambda x: x["tool"]), ",").alias("tools"), "decision", F.array_join("risks", ",").alias("risk_flags"), round_to(score, 2).alias("score"))


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern fits."""
    out = F.when(F.lit(False), "")
    for pattern, name in rules:
        out = out.when(matches(text, pattern), name)
    return out.otherwise(otherwise)


#: Fixed: how a failing first test run is told apart, and what a browser page may have met.
RED = [(r"cannot find module|modulenotfounderror|importerror|no module named", "import"), (r"syntaxerror|unexpected token|parse error", "syntax"), (r"assert|expected|tobe|toequal", "assertion")]
