"""Column functions over text: trimming, byte-bounded previews, names, quoting, versions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode white-space characters that trimming removes.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ELLIPSIS = "…"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim_space(c: Column | str) -> Column:
    """Trim Unicode white space on both ends (``trim`` removes blanks only)."""
    return F.btrim(as_col(c), F.lit(WHITE_SPACE))


def blank_to(c: Column | str, default: str) -> Column:
    c = as_col(c)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def first_line(c: Column | str) -> Column:
    """Text up to the first line feed, trimmed."""
    return trim_space(F.substring_index(as_col(c), "\n", 1))


def truncate_utf8(c: Column | str, max_bytes: int = 120) -> Column:
    """At most ``max_bytes`` bytes, never inside a character; an ellipsis marks a cut."""
    c = as_col(c)
    raw = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string"))
            for n in range(max_bytes, max(max_bytes - 4, -1), -1)]
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(
        F.concat(F.coalesce(*cuts, F.lit("")), F.lit(ELLIPSIS)))


def tail_text(c: Column | str, max_bytes: int = 4096) -> Column:
    """The last ``max_bytes`` bytes, from the first whole line on; trailing line feeds dropped."""
    c = as_col(c)
    raw = c.cast("binary")
    size = F.octet_length(c)
    cuts = [F.try_validate_utf8(raw.substr(size - max_bytes + 1 + n, F.lit(max_bytes - n)).cast("string"))
            for n in range(4)]
    tail = F.coalesce(*cuts)
    at = F.instr(tail, "\n")
    whole = F.when((at > 0) & (at < F.length(tail)), tail.substr(at + 1, F.length(tail))).otherwise(tail)
    no_feeds = "\\n+\\z"
    return F.when(size <= max_bytes, F.regexp_replace(c, no_feeds, "")).otherwise(
        F.concat(F.lit(ELLIPSIS), F.regexp_replace(whole, no_feeds, "")))


def sanitize(c: Column | str, blank: str = "") -> Column:
    """Lower-case name token: one underscore per character outside [a-z0-9], ends trimmed."""
    token = F.btrim(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]", "_"), F.lit("_"))
    return blank_to(token, blank) if blank else token


def check_name(schema: Column | str, name: Column | str, suffix: Column | str) -> Column:
    """``schema_name_suffix``; a blank or ``public`` schema is left out."""
    schema = as_col(schema)
    plain = schema.isNull() | schema.isin("", "public")
    prefix = F.when(plain, F.lit("")).otherwise(F.concat(sanitize(schema), F.lit("_")))
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(prefix, sanitize(name), F.lit("_"), suffix)


def skeleton_file_name(c: Column | str) -> Column:
    """A safe file stem: other characters become ``-``, ends trimmed, blank becomes ``repository``."""
    stem = F.btrim(F.regexp_replace(as_col(c), "[^A-Za-z0-9._-]", "-"), F.lit("-."))
    return blank_to(stem, "repository")


def is_temp_name(c: Column | str) -> Column:
    """Scratch files: dotfiles, editor backups and temporary or lock suffixes."""
    base = F.substring_index(as_col(c), "/", -1)
    return (base == "") | base.startswith(".") | base.endswith("~") | F.lower(base).rlike(
        "\\.(tmp|swp|part|lock)\\z")


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: str) -> str:
    """A Spark SQL string literal; prefer ``spark.sql(..., args=...)`` where possible."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(c: Column | str) -> Column:
    """The text in double quotes, with quotes, backslashes and line ends escaped."""
    c = F.replace(F.replace(as_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    c = F.replace(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                  F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def version_parts(c: Column | str) -> Column:
    """[major, minor, patch] of a strict X.Y.Z (optional ``v``); null when not comparable."""
    c = as_col(c)
    strict = c.rlike("\\Av?[0-9]+\\.[0-9]+\\.[0-9]+\\z")
    parts = F.transform(F.split(F.regexp_replace(c, "\\Av", ""), "\\."), lambda p: p.try_cast("bigint"))
    return F.when(strict & ~F.exists(parts, lambda p: p.isNull()), parts)


def canonical_entry(prev_hash, id, tenant_id, seq, created_at, report_sha256, verdict) -> Column:
    """The text an entry hash commits to: eight fields, one per line. A null field stays an empty line."""
    fields = [prev_hash, id, tenant_id, seq, created_at, report_sha256, verdict]
    return F.concat_ws("\n", F.lit("v1"), *[F.coalesce(as_col(f).cast("string"), F.lit("")) for f in fields])
