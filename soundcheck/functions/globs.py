"""File globs as regular expressions, in two dialects."""

from __future__ import annotations

import re


def glob_regex(pattern: str, dialect: str = "path") -> str:
    """``path``: ``*`` and ``?`` stop at ``/``. ``find``: they cross it."""
    star, one = (r"[^/]*", r"[^/]") if dialect == "path" else (r"(?s:.*)", r"(?s:.)")
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(star)
        elif ch == "?":
            out.append(one)
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif ch == "[" and pattern.find("]", i + 2) > 0:
            end = pattern.find("]", i + 2)
            body = pattern[i + 1:end]
            negate = body[0] in "^!"
            body = (body[1:] if negate else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            keep_slash = "(?!/)" if dialect == "path" else ""
            out.append(f"{keep_slash}[{'^' if negate else ''}{body}]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def split_segments(pattern: str, dialect: str = "path") -> list[str]:
    """The parts of a pattern between slashes, which a class or an escape may hold too; where ``*`` crosses slashes, the whole."""
    if dialect != "path":
        return [pattern]
    out, start, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "/":
            out.append(pattern[start:i])
            start = i + 1
        elif pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[" and pattern.find("]", i + 2) > 0:
            i = pattern.find("]", i + 2)
        i += 1
    return [*out, pattern[start:]]


def anchor(segment: str) -> tuple[str, str]:
    """What a name that fits ``segment`` must have: (literal | prefix | suffix | inside | any, that text).

    The longest stretch without a wildcard is taken, so that few names have it.
    """
    runs, text, i = [], "", 0
    while i < len(segment):
        ch = segment[i]
        if ch in "*?":
            runs.append(text)
            text = ""
        elif ch == "[" and segment.find("]", i + 2) > 0:
            runs.append(text)
            text, i = "", segment.find("]", i + 2)
        else:
            i += ch == "\\" and i + 1 < len(segment)
            text += segment[i]
        i += 1
    if not runs:
        return "literal", text
    kinds = [("prefix", runs[0]), ("suffix", text), *(("inside", r) for r in runs[1:])]
    best = max(kinds, key=lambda k: len(k[1]))
    return best if best[1] else ("any", "")
