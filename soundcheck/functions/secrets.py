"""Redaction columns: known-value scrubbing, bounded previews, credential shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from soundcheck.functions.text import as_col, first_line, let, truncate_utf8

# Limits and markers.
PREVIEW_BYTES = 120
INLINE_BYTES = 256
MIN_SECRET_BYTES = 4
BARE_MARKER = "[REDACTED]"
FINGERPRINT = r"\[sha256:[0-9a-f]{64}\]\z"

# The four credential shapes. ASCII look-arounds stand for a word boundary, since the
# Java \b counts accented letters as word characters.
_START = r"(?<![0-9A-Za-z_])"
_END = r"(?![0-9A-Za-z_])"
CREDENTIAL_PATTERNS = {
    "aws-access-key-id": _START + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _END,
    "private-key-pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "bearer-token": _START + r"(?i:bearer)[ \t]+[A-Za-z0-9\-._~+/]{20,}=*",
    "url-credentials": _START + r"""[a-zA-Z][a-zA-Z0-9+.-]*://[^/ \t\n\f\r:@"'`]+:[^@/ \t\n\f\r"'`\[\]]{3,}@""",
}


def marker(name: str | None) -> str:
    return f"[REDACTED:{name}]" if name else BARE_MARKER


def longest_first(secrets: Sequence[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    """Longest value first (in bytes), so that no part of a longer value is left; ties keep their order."""
    usable = [(n, v) for n, v in secrets if len(v.encode()) >= MIN_SECRET_BYTES]
    return sorted(usable, key=lambda nv: -len(nv[1].encode()))


def redact_captured(scrubbed: Column) -> Column:
    """Scrubbed output as a first-line preview and the SHA-256 of the whole scrubbed text."""
    mark = F.concat(F.lit("[sha256:"), F.sha2(scrubbed.cast("binary"), 256), F.lit("]"))
    preview = let(first_line(scrubbed), lambda line: truncate_utf8(line, PREVIEW_BYTES))
    return let(preview, lambda p: F.concat(p, F.when(p == "", F.lit("")).otherwise(F.lit(" ")), mark))


def redact_got(scrubbed: Column, keep_literal: Column) -> Column:
    """Short one-line values and kept literals stay; anything else becomes preview and fingerprint."""
    short = ~scrubbed.rlike("[\n\r]") & (F.octet_length(scrubbed) <= INLINE_BYTES)
    return F.when(F.coalesce(keep_literal, F.lit(False)) | short, scrubbed).otherwise(redact_captured(scrubbed))


def redact_warnings(raw: Column, scrubbed: Column) -> Column:
    """Preview and fingerprint, unless blank or already ending in a fingerprint."""
    done = raw.isNull() | (raw == "") | raw.rlike(FINGERPRINT)
    return F.when(done, raw).otherwise(redact_captured(scrubbed))


# Text without these parts cannot match; looking for them is far cheaper than a regular expression.
_NEEDED = {
    "aws-access-key-id": lambda c: c.contains("AKIA") | c.contains("ASIA"),
    "private-key-pem": lambda c: c.contains("-----BEGIN "),
    "bearer-token": lambda c: F.lower(c).contains("bearer"),
    "url-credentials": lambda c: c.contains("://"),
}


def credential_counts(c: Column | str) -> Column:
    """array<struct<pattern, count>> of the shapes that occur; never the matched text."""
    c = as_col(c)
    count = lambda name, rx: F.when(_NEEDED[name](c), F.regexp_count(c, F.lit(rx))).otherwise(F.lit(0)).cast("bigint")
    found = F.array(*[F.struct(F.lit(name).alias("pattern"), count(name, rx).alias("count"))
                      for name, rx in CREDENTIAL_PATTERNS.items()])
    return F.filter(found, lambda x: x["count"] > 0)


def scrub_patterns(c: Column | str) -> Column:
    """Rewrite bearer tokens and the password part of a URL, whatever their value."""
    c = F.regexp_replace(as_col(c), _START + r"(?i:bearer)[ \t\n\f\r]+[A-Za-z0-9._~+/=-]{4,}",
                         "Bearer [REDACTED]")
    return F.regexp_replace(c, r"(://[^/:@ \t\n\f\r]+:)[^@ \t\n\f\r]+(@)", "$1[REDACTED]$2")
