"""Security-probe signatures and robots rules, as Spark SQL expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: File names of known web shells.
SHELLS = ("c99.php", "r57.php", "shell.php", "cmd.php", "wso.php")

#: Signatures over the raw request target, applied before any log is written; letters in either case.
STATIC_SIGNATURES = {
    "env-file-scan": r"(?i)(?:^|/)\.env(?:[./?]|\z)",
    "git-metadata-scan": r"(?i)(?:^|/)\.git(?:/|\?|\z)",
    "log4shell-probe": r"(?i)\x24\{jndi:",
    "path-traversal-scan": r"(?i)(?:^|/|\\|%2f|%5c)(?:\.\.|%2e%2e)(?:/|\\|%2f|%5c|\?|\z)",
    "phpmyadmin-scan": r"(?i)^/(?:phpmyadmin|pma)/",
    "shell-probe": r"(?i)(?:^|/)(?:c99|r57|shell|cmd|wso)\.php(?:\?|\z)",
    "wp-login-scan": r"(?i)^/(?:wp-login\.php(?:\?|\z)|wp-admin/)",
}


def traversal(path: str) -> str:
    """Whether a decoded path has a segment `..` between slashes or backslashes."""
    return f"exists(split({path}, '[/\\\\\\\\]'), s -> s = '..')"


def security_probes(method: str, uri: str, decoded: str, status: str) -> str:
    """Sorted ids of the signatures that a request matches. `decoded` may be null: then the raw target stands for it."""
    low, path = f"lower({uri})", f"lower(coalesce({decoded}, {uri}))"
    failed = f"(upper({method}) IN ('GET', 'HEAD') AND {status} IN (400, 401, 403, 404))"
    base = f"element_at(split(regexp_replace({path}, '/+\\\\z', ''), '/'), -1)"
    cases = {
        "env-file-scan": f"{path} = '/.env' OR startswith({path}, '/.env.')",
        "git-metadata-scan": f"startswith({path}, '/.git/')",
        "log4shell-probe": f"contains({low}, '${{jndi:')",
        "path-traversal-scan": traversal(path),
        "phpmyadmin-scan": f"{failed} AND (startswith({path}, '/phpmyadmin/') OR startswith({path}, '/pma/'))",
        "shell-probe": f"{base} IN {SHELLS}",
        "wp-login-scan": f"{failed} AND ({path} = '/wp-login.php' OR startswith({path}, '/wp-admin/'))",
    }
    return "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in cases.items()) + "))"


def static_signatures(uri: str) -> str:
    """Sorted ids of the static signatures that a raw request target matches."""
    quoted = {k: p.replace("\\", "\\\\") for k, p in STATIC_SIGNATURES.items()}
    return "array_compact(array(" + ", ".join(f"CASE WHEN {uri} RLIKE '{p}' THEN '{k}' END" for k, p in quoted.items()) + "))"


@dataclass(frozen=True)
class RobotsRule:
    agent: str
    allow: bool
    path: str

    @property
    def pattern(self) -> str:
        """The path as a regular expression: `*` is anything, a final `$` is the end."""
        body = self.path.removesuffix("$")
        return "^" + ".*".join(re.escape(x) for x in body.split("*")) + ("\\z" if self.path.endswith("$") else "")


def parse_robots(text: str) -> list[RobotsRule]:
    """Rules of a robots.txt, in order; an empty Disallow is no rule."""
    rules, agents, in_rules = [], [], False
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents, in_rules = ([] if in_rules else agents) + [value.lower()], False
        elif name in ("allow", "disallow"):
            in_rules = True
            if value:
                rules += [RobotsRule(a, name == "allow", value) for a in agents]
    return rules


def robots_allowed(rules: list[RobotsRule], agent: str, path: str) -> str:
    """Verdict for a claimed crawler: the group with the longest name that the agent starts with, else `*`; in it the
    longest matching path, the first on ties; no match allows."""
    groups = sorted({r.agent for r in rules}, key=lambda a: (a == "*", -len(a), a))

    def verdict(group: str) -> str:
        own = sorted((r for r in rules if r.agent == group), key=lambda r: -len(r.path))
        quoted = [(r.pattern.replace("\\", "\\\\").replace("'", "\\'"), str(r.allow).lower()) for r in own]
        return "CASE " + " ".join(f"WHEN {path} RLIKE '{p}' THEN {v}" for p, v in quoted) + " ELSE true END"

    if not groups:
        return "true"
    cases = " ".join(f"WHEN {'true' if g == '*' else f'startswith(lower({agent}), {chr(39)}{g}{chr(39)})'} THEN {verdict(g)}" for g in groups)
    return f"(CASE {cases} ELSE true END)"
