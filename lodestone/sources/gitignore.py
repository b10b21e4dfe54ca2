"""Ignore rules as in .gitignore files: negation, anchors, directory-only rules, ``**``."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    keep: bool
    directory: bool


def to_regex(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.*", k + 3
            continue
        if c == "*":
            while glob.startswith("*", k + 1):
                k += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            k = end
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out += re.escape(glob[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def parse(text: str, base: str = "") -> list[Rule]:
    """Rules of one file that stands in the folder ``base``, for paths that begin with it; no base: for paths below the folder."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        directory = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = to_regex(line.lstrip("/"))
        prefix = re.escape(base.rstrip("/")) + "/" if base else ""
        rules.append(Rule(re.compile(prefix + ("" if anchored else "(?:.*/)?") + body + r"\Z"), keep, directory))
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """By the last rule that matches the path itself."""
    out = False
    for rule in rules:
        if (is_dir or not rule.directory) and rule.pattern.match(path):
            out = not rule.keep
    return out
