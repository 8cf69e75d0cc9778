"""Predicates on lines, paths and addresses. The patterns and sets are fixed values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extension

# What makes a line an error, a command, a stack frame, a decision, and so on.
ERROR = r"(error|failed|failure|exception|traceback|panic|fatal|cannot find|not found|timeout|timed out|eaddrinuse|npm err!|assertion|segmentation|denied|permission|syntaxerror|typeerror|referenceerror|fail\b)"
COMMAND = r"^(\$|>|❯|➜)\s+.+|^(npm|pnpm|yarn|bun|pytest|python|node|tsc|vite|playwright|docker|git|go|cargo|make)\s+.+"
STACK = r"^\s*(at\s+.+\(.+\:\d+\:\d+\)|File \".+\", line \d+|.+\.(ts|tsx|js|jsx|py|go|rs|java|rb|php):\d+)"
FILE = r"(?:^|\s|[\"'(`])([A-Za-z0-9_./@-]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|php|css|scss|astro|json|ya?ml|md|sql|sh|tsx?))(?::\d+)?"
DECISION = "(решили|решение|итог|вывод|decided|decision|conclusion|we will|we agreed)"
ACTION = "(todo|action item|next step|follow[- ]?up|надо|нужно|сделать|починить|добавить|реализовать|проверить|fix|implement|ship|deploy)"
RISK = "(risk|риск|blocker|blocked|опасн|проблем|timeout|ошибка|regression|security|auth|credential|secret)"
QUESTION = r"(\?|вопрос|неясно|уточн|tbd|open question|unclear|confirm)"
CRITICAL = "quality gate|guardrail|policy|must|requires?|do not|don't|should|error|failed|exception|root cause|evidence|decision|risk|action|todo|fix|warning|exact command|exact env|caveat|timing|следующее действие|запустить"
NOISE = r"^noise\b|unrelated|generic product prose|background|misleading note"
UNIT_SCORES = (
    ("quality gate|guardrail|policy|must|requires?|should|error|failed|exception|root cause|decision|risk|action|todo|fix|warning", 5),
    (r"```|\{|\}|\(|\)|\b[A-Z0-9_]{4,}\b|\.ts|\.js|\.py|\.md|npm|node|git", 3),
    (r"[$€£]\d|\d+(?:\.\d+)?%|\b\d{4}-\d{2}-\d{2}\b|\b\d+(?:\.\d+)?x\b", 2),
    (r"(?m)^#{1,6}\s|^[A-Z][A-Za-z0-9 -]{2,60}$", 2),
    (r"^noise\b|unrelated|generic product prose|background", -8),
)
#: A cheap search that all texts pass which one of the dearer patterns is in.
FIRST_LOOK = {UNIT_SCORES[2][0]: "[$€£][0-9]|[0-9][-%xX]"}
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".woff", ".woff2", ".ttf", ".otf", ".mp3", ".mp4", ".mov", ".sqlite")
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst")
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".rb", ".php", ".css", ".scss", ".sh", ".sql")
GENERATED_PARTS = ("dist", "coverage", "node_modules", ".artifacts", ".cache")

#: Java's \b looks at Unicode letters; this one is ASCII, as elsewhere.
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def alternatives(pattern: str, joined: bool = True) -> tuple[list[str], str]:
    """The plain words among a pattern's outermost alternatives, lower-cased, and a pattern of the others; not joined: a list of all."""
    if joined and re.fullmatch(r"\((?!\?)[^()]*\)", pattern):
        pattern = pattern[1:-1]
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|[()|]", pattern):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "|" and not depth:
            parts.append(pattern[at : m.start()])
            at = m.end()
    parts.append(pattern[at:])
    if not joined:
        return [], parts
    plain = [x.lower() for x in parts if re.fullmatch(r"[^\\.^$*+?()\[\]{}|]+", x)]
    return plain, "|".join(x for x in parts if x.lower() not in plain)


def matches(text: Column, pattern: str, lowered: Column | None = None) -> Column:
    """A case-insensitive search, letters of any alphabet, word edges in ASCII.

    Plain words are sought in the lower-cased text (`lowered`, if the caller has it), which is much faster than an alternation.
    """
    plain, rest = ([], pattern) if pattern.startswith("(?") else alternatives(pattern)
    low = F.lower(text) if lowered is None else lowered
    found = [low.contains(x) for x in plain]
    if rest:
        fits = text.rlike("(?iu)" + rest.replace(r"\b", ASCII_EDGE))
        found.append(text.rlike(FIRST_LOOK[pattern]) & fits if pattern in FIRST_LOOK else fits)
    return reduce(lambda a, b: a | b, found)


def folded(text: Column) -> Column:
    """text in which a word that a pattern finds whatever its case is found as it is, in lower case."""
    return F.lower(F.replace(F.upper(text), F.lit("İ"), F.lit("I")))


def needed(pattern: str) -> list[str]:
    """Words of which a text has one, folded, if the pattern is in it; none if no such words of two letters are seen."""
    out = []
    for part in alternatives(pattern, False)[1]:
        part = re.sub(r"\(\?:[^()]*\)[?*]?", "\0", part.replace(r"\b", ""))
        whole = re.fullmatch(r"\(((?!\?)[^()]*)\)", part)
        if whole:
            own = needed(whole[1])
        else:
            group = re.search(r"\(((?!\?)[^()]*)\)(?![?*{])", part)
            part = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "\0", part)
            while (less := re.sub(r"\([^()]*\)", "\0", part)) != part:
                part = less
            own = [max(re.split(r"[\0^$.+]", re.sub(r".(?:[?*]|\{[^}]*\})", "\0", part)), key=len).lower()]
            if len(own[0]) < 2 and group:
                own = needed(group[1])
        if not own or min(map(len, own)) < 2:
            return []
        out += own
    return out


def matches_folded(text: Column, fold: Column, pattern: str) -> Column:
    """matches(), with a look for the pattern's words in the folded text first: most texts have none of them."""
    words, found = needed(pattern), matches(text, pattern)
    return reduce(lambda a, b: a | b, (fold.contains(x) for x in dict.fromkeys(words))) & found if words else found


def is_sensitive_path(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = [p.contains(x) for x in ("credentials.md", "/.env", "secret", "token", "auth.json")] + [p.endswith(x) for x in (".pem", ".key")]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def is_binary_path(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def filter_reason(path: Column) -> Column:
    return F.when(is_sensitive_path(path), "sensitive-path").when(is_binary_path(path), "binary-extension")


def is_generated(path: Column) -> Column:
    parts = F.split(path, "/")
    inside = F.arrays_overlap(parts, F.array(*map(F.lit, GENERATED_PARTS)))
    return inside | path.contains("live-snapshot") | path.endswith(".lock") | path.endswith("package-lock.json") | path.endswith(".snap")


def category(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*DOC_EXTENSIONS), "docs").when(e.isin(*CODE_EXTENSIONS), "code").otherwise("other")


def has_frontmatter(text: Column) -> Column:
    return text.rlike(r"(?s)^---\r?\n.*?\r?\n---\r?\n")


def is_external_link(target: Column) -> Column:
    return target.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)")


def is_private_ip(host: Column) -> Column:
    """Private, loopback and link-local addresses of both kinds."""
    v4 = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    four = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.try_element_at(v4, F.lit(1)), F.try_element_at(v4, F.lit(2))
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    six = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    local = six.isin("::1", "::") | six.rlike("^f[cd][0-9a-f]{2}:") | six.rlike("^fe[89ab][0-9a-f]:")
    return F.when(four, private).otherwise(local)


def url_guard(url: Column, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """Why an address may not be fetched, else null."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    out = F.when(~scheme.isin("http", "https"), "protocol").when(host == "", "host")
    out = out.when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | is_private_ip(host), "private")
    if allowed_hosts:
        fits = F.lit(False)
        for x in allowed_hosts:
            fits = fits | (host == x) | host.endswith("." + x)
        out = out.when(~fits, "not allowed")
    return out


def in_window(ts: Column, since: str, until: str) -> Column:
    """Half-open, and false for a missing time; a plain comparison, so it reaches the scan."""
    return (ts >= F.lit(since).cast("timestamp")) & (ts < F.lit(until).cast("timestamp"))


def is_network_failure(code: Column, text: Column) -> Column:
    return F.when(code >= 400, True).when(code > 0, False).otherwise(F.coalesce(matches(text, "failed|aborted|timeout|refused|reset|err_"), F.lit(False)))
