"""Redaction of known secrets and scanning for credential shapes, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from soundcheck.functions import secrets as S
from soundcheck.plans.sizing import batches
from soundcheck.session import materialise

SECRETS_PER_PASS = 50_000
BYTES_PER_SCAN = 1 << 20


def known_secrets(names: DataFrame, values: DataFrame) -> DataFrame:
    """ord, name, value of the usable secrets: the first of equal names, no blank names, no value under
    four bytes. ``names``: ord, name. ``values``: name, value."""
    first = names.filter(F.coalesce(F.col("name"), F.lit("")) != "").groupBy("name").agg(F.min("ord").alias("ord"))
    return first.join(values, "name").filter(F.octet_length("value") >= S.MIN_SECRET_BYTES).select(
        "ord", "name", "value")


@dataclass
class Scrubber:
    """Replaces known values in string columns, in array<string> columns and in every string of a nested value."""

    text: Callable[[Column], Column]
    texts: Callable[[Column], Column]
    every: Callable[[Column, T.DataType], Column]  # a value of that type; map keys stay
    held: object  # the broadcast passes, for functions that run on a worker


def scrubber(secrets: DataFrame, per_pass: int = SECRETS_PER_PASS) -> Scrubber:
    """A scrubber for ``secrets`` (ord, name, value).

    Values are replaced one after the other, longest first and equal lengths in their order, however many
    there are. They are streamed to the driver in passes of at most ``per_pass`` values; workers index the
    broadcast passes together and find the values of all of them in one scan (see ``Known``). No value
    stands in a plan, so none shows in explain output or event logs.
    """
    usable = secrets.filter(F.octet_length("value") >= S.MIN_SECRET_BYTES)
    ranked = usable.orderBy(F.octet_length("value").desc(), F.col("ord").asc(), F.col("name").asc()).select("name", "value")
    passes = [[(S.marker(r["name"]), r["value"]) for r in part] for part in batches(ranked, per_pass, ordered=True)]
    held = secrets.sparkSession.sparkContext.broadcast(passes)

    def every(c: Column, kind: T.DataType) -> Column:
        return _known_udf(held, kind)(c) if passes else c

    return Scrubber(lambda c: every(c, T.StringType()), lambda c: every(c, T.ArrayType(T.StringType())), every, held)


class Known:
    """The values of all passes, found by one scan of a text's bytes, however many values there are.

    Every window of eight bytes (four, for values under eight) is looked up in a bitmap and then in the sorted
    list of the values' first bytes; only where these agree is the whole value compared.
    """

    def __init__(self, passes):
        self.pairs = [pair for part in passes for pair in part]
        self.tails: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}
        for i, (_, value) in enumerate(self.pairs):
            raw = value.encode()
            by_length = self.tails.setdefault(raw[:8 if len(raw) >= 8 else 4], {})
            by_length.setdefault(len(raw), {}).setdefault(raw, []).append(i)
        self.widths = []
        for width in (4, 8):
            heads = np.sort(np.frombuffer(b"".join(h for h in self.tails if len(h) == width), f"<u{width}"))
            if len(heads):
                bits = min(max(len(heads).bit_length() + 6, 12), 24)
                mixer = heads.dtype.type(0x9E3779B97F4A7C15 if width == 8 else 0x9E3779B1), heads.dtype.type(8 * width - bits)
                bitmap = np.zeros(1 << bits, bool)
                bitmap[(heads * mixer[0]) >> mixer[1]] = True
                self.widths.append((width, heads, bitmap, mixer))

    def places(self, raw) -> Iterator[tuple[int, int, list[int]]]:
        """Position, length and numbers in ``pairs`` of every value that occurs in ``raw``, overlapping ones too."""
        whole = np.frombuffer(raw, np.uint8)
        for width, heads, bitmap, (factor, shift) in self.widths:
            for lo in range(0, len(whole) - width + 1, BYTES_PER_SCAN):
                part = whole[lo:lo + BYTES_PER_SCAN + width - 1]
                windows = np.ndarray(len(part) - width + 1, heads.dtype, part, strides=(1,))
                at = np.flatnonzero(bitmap[(windows * factor) >> shift])
                near = windows[at]
                at = at[heads[np.minimum(np.searchsorted(heads, near), len(heads) - 1)] == near] + lo
                for i in at.tolist():
                    for length, values in self.tails[whole[i:i + width].tobytes()].items():
                        numbers = values.get(whole[i:i + length].tobytes())
                        if numbers:
                            yield i, length, numbers

    def replace(self, s: str | None) -> str | None:
        """``s`` with the values replaced in the order of ``pairs``; only values that occur are visited."""
        at = 0
        while s:
            nxt = min((i for _, _, numbers in self.places(s.encode("utf-8", "surrogatepass")) for i in numbers if i >= at), default=None)
            if nxt is None:
                break
            mark, value = self.pairs[nxt]
            s, at = s.replace(value, mark), nxt + 1
        return s

    def scrub(self, texts: pa.Array) -> pa.Array:
        """A string array; texts without a known value are not touched, nor made Python objects."""
        data = texts.buffers()[2]
        if not len(texts) or data is None:
            return texts
        wide = pa.types.is_large_string(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
        found = set()
        for i, length, _ in self.places(memoryview(data)[ends[0]:ends[-1]]):
            row = int(np.searchsorted(ends, i + ends[0], "right")) - 1
            if i + ends[0] + length <= ends[row + 1]:
                found.add(row)
        return _with_rows(texts, sorted(found), self.replace)


def _with_rows(texts: pa.Array, rows, fn) -> pa.Array:
    """``texts`` with ``fn`` applied to the given rows."""
    if not len(rows):
        return texts
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    made = pa.array([None if (s := texts[int(i)].as_py()) is None else fn(s) for i in rows], texts.type)
    return pc.replace_with_mask(texts, pa.array(mask), made)


def _holds_text(kind: pa.DataType) -> bool:
    if pa.types.is_map(kind):
        return _holds_text(kind.item_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return _holds_text(kind.value_type)
    if pa.types.is_struct(kind):
        return any(_holds_text(kind.field(i).type) for i in range(kind.num_fields))
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _every_text(values: pa.Array, text: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``values`` with ``text`` applied to its string arrays at any depth; map keys stay."""
    kind = values.type
    if not _holds_text(kind):
        return values
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_every_text(values.field(i), text) for i in range(kind.num_fields)],
                                          fields=[kind.field(i) for i in range(kind.num_fields)], mask=values.is_null())
    if not (pa.types.is_map(kind) or pa.types.is_list(kind) or pa.types.is_large_list(kind)):
        return text(values)
    ends = values.offsets.to_numpy()  # of this slice, while the children are those of the whole array
    inside = lambda child: child.slice(ends[0], ends[-1] - ends[0])
    offsets = pa.array(ends - ends[0], values.offsets.type)
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(offsets, inside(values.keys), _every_text(inside(values.items), text), type=kind, mask=values.is_null())
    return type(values).from_arrays(offsets, _every_text(inside(values.values), text), type=kind, mask=values.is_null())


def _evaluated_apart(udf):
    """Keep the optimizer from moving the call into another expression, where it could not run in a lambda."""
    return udf.asNondeterministic()


def _known_udf(held, kind: T.DataType):
    @F.arrow_udf(kind)
    def apply(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(held.value)
        for values in it:
            yield _every_text(values, known.scrub)
    return _evaluated_apart(apply)


def scrub(df: DataFrame, columns: list[str], secrets: DataFrame, **sizes) -> DataFrame:
    """Replace every known value in the given text columns."""
    s = scrubber(secrets, **sizes)
    return df.withColumns({c: s.text(F.col(c)) for c in columns})


def redact_captures(df: DataFrame, got: str, keep_literal: Column | str, secrets: DataFrame, **sizes) -> DataFrame:
    """The stored form of captured output: short one-line values scrubbed, the rest preview and fingerprint."""
    s = scrubber(secrets, **sizes)
    keep = F.col(keep_literal) if isinstance(keep_literal, str) else keep_literal
    # The scrubbed text is a column of its own, so that it is computed once.
    scrubbed = df.withColumns({"_scrubbed": s.text(F.col(got)), "_keep": keep})
    return scrubbed.withColumn(got, S.redact_got(F.col("_scrubbed"), F.col("_keep"))).drop("_scrubbed", "_keep")


def redact_reports(reports: DataFrame, secrets: DataFrame, **sizes) -> DataFrame:
    """Reports as they may be stored or sent. Redacting twice changes nothing."""
    s = scrubber(secrets, **sizes)
    # One struct, so that all texts of a report go to one Python worker, and a column of its own, so that it is computed once.
    texts = F.struct(*[F.col(f"checks.{c}").alias(c) for c in ("got", "detail", "error")],
                     F.col("load.warnings").alias("warnings"), F.col("load.error").alias("load_error"))
    done = reports.withColumn("_texts", s.every(texts, reports.select(texts.alias("t")).schema["t"].dataType))
    load = F.col("load").withField("warnings", S.redact_warnings(F.col("load.warnings"), F.col("_texts.warnings"))).withField(
        "error", F.col("_texts.load_error"))

    # Zipped, since the result of a Python function must not be read inside a lambda by position.
    together = F.arrays_zip(F.col("checks").alias("c"), F.col("_texts.got").alias("g"), F.col("_texts.detail").alias("d"),
                            F.col("_texts.error").alias("e"))

    def check(z):
        c, got = z["c"], z["g"]
        blank = c["got"].isNull() | (c["got"] == "")
        stored = F.when(blank, got).otherwise(S.redact_got(got, c["keep_literal"]))  # a stored preview is short, so it stays
        return c.withField("got", stored).withField("detail", z["d"]).withField("error", z["e"])

    checks = F.when(F.col("checks").isNotNull(), F.transform(together, check))
    return done.withColumns({"load": load, "checks": checks}).drop("_texts")


def raw_output(before: DataFrame, after: DataFrame) -> DataFrame:
    """The raw values that redaction replaced: run_id, part, name, raw. For local display only; sinks refuse it.

    Of the stored side only digests are shuffled.
    """
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    b = before.select("run_id", "part", F.col("load.warnings").alias("bw"), F.transform("checks", lambda c: F.struct(
        c["name"].alias("name"), c["got"].alias("got"))).alias("bc"))
    a = after.select("run_id", "part", digest(F.col("load.warnings")).alias("aw"),
                     F.transform("checks", lambda c: digest(c["got"])).alias("ac"))
    both = b.join(a, ["run_id", "part"])
    checks = F.transform(F.arrays_zip("bc", "ac"), lambda z: F.struct(
        z["bc"]["name"].alias("name"), z["bc"]["got"].alias("raw"), z["ac"].alias("stored")))
    warning = F.array(F.struct(F.lit("load warnings").alias("name"), F.col("bw").alias("raw"), F.col("aw").alias("stored")))
    return both.select("run_id", "part", F.explode(F.concat(warning, checks)).alias("v")).filter(
        ~digest(F.col("v.raw")).eqNullSafe(F.col("v.stored"))).select("run_id", "part", "v.name", "v.raw")


def scan_credentials(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """id, pattern, count of the credential shapes in a text; never the matched text. No shuffle."""
    # The outer form, since Spark guards a plain explode with a filter that scans every text a second time.
    return df.select(id_col, F.explode_outer(S.credential_counts(col)).alias("m")).filter("m IS NOT NULL").select(
        id_col, "m.pattern", F.col("m.count").alias("count"))


def decided(df: DataFrame, col: str, mode: str = "refuse") -> DataFrame:
    """Rows with a ``decision``: accept, or ``mode`` where a credential shape occurs; ``off`` does not scan."""
    if mode not in ("refuse", "warn", "off"):
        raise ValueError(f"mode {mode!r} unsupported (refuse|warn|off)")
    if mode == "off":
        return df.withColumn("decision", F.lit("accept"))
    hit = F.size(S.credential_counts(col)) > 0
    return df.withColumn("decision", F.when(F.coalesce(hit, F.lit(False)), F.lit(mode)).otherwise(F.lit("accept")))


def credential_gate(df: DataFrame, col: str, mode: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined) rows, each with a ``decision``: accept, warn or refuse.

    ``refuse`` quarantines a row with any credential shape, ``warn`` lets it pass marked, ``off`` does
    not scan. Texts are scanned once, into a written table divided by decision.
    """
    judged = decided(df, col, mode)
    if mode == "refuse":
        judged = materialise(judged.withColumn("_decision", F.col("decision")), "gate", ["_decision"]).drop("_decision")
    return judged.filter("decision <> 'refuse'"), judged.filter("decision = 'refuse'")


def gate_summary(df: DataFrame, col: str, mode: str = "refuse") -> DataFrame:
    """decision and number of rows."""
    return decided(df, col, mode).groupBy("decision").agg(F.count(F.lit(1)).alias("rows"))


# -- nested payloads -----------------------------------------------------------------------------

def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def scrub_payload(df: DataFrame, secrets: DataFrame, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Scrub every string at any depth of every column, keys untouched; known values, then shapes.

    Columns that hold text are walked by their schema as Arrow arrays, free JSON text (``json_columns``) is decoded,
    walked and encoded; all columns of a row go to one Python worker. The markers are unnamed: a boundary must not
    tell which secret matched.
    """
    s = scrubber(secrets.withColumn("name", F.lit(None).cast("string")))
    kind = T.StructType([T.StructField(f.name, T.StringType() if f.name in json_columns else f.dataType) for f in df.schema.fields
                         if f.name in json_columns or _has_text(f.dataType)])
    if not kind.fields:
        return df
    clean = "_clean"
    while clean in df.columns:
        clean = f"_{clean}"
    done = df.withColumn(clean, _payload_udf(s.held, kind, frozenset(json_columns))(F.struct(*[F.col(f.name) for f in kind.fields])))
    return done.select(*[(F.col(clean)[f.name] if f.name in kind.names else F.col(f.name)).alias(f.name) for f in df.schema.fields])


def _payload_udf(held, kind: T.StructType, json_columns: frozenset[str]):
    @F.arrow_udf(kind)
    def apply(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Known(held.value)
        shapes = _shapes()
        texts = lambda values: _with_shapes(known.scrub(values), shapes)
        one_json = _json_scrub(lambda s: shapes(known.replace(s)))
        for rows in it:
            fields = [rows.type.field(i) for i in range(rows.type.num_fields)]
            yield pa.StructArray.from_arrays(
                [_by_parts(rows.field(i), one_json) if f.name in json_columns else _every_text(rows.field(i), texts)
                 for i, f in enumerate(fields)], fields=fields)
    return _evaluated_apart(apply)


def _shapes():
    """A function that rewrites the two shapes in one text."""
    import re
    bearer = re.compile(r"(?i)(?<![0-9A-Za-z_])bearer[ \t\n\f\r]+[A-Za-z0-9._~+/=-]{4,}", re.ASCII)
    password = re.compile(r"(://[^/:@ \t\n\f\r]+:)[^@ \t\n\f\r]+(@)")
    return lambda s: password.sub(rf"\1{S.BARE_MARKER}\2", bearer.sub(f"Bearer {S.BARE_MARKER}", s))


def _with_shapes(texts: pa.Array, shapes) -> pa.Array:
    """Texts without these parts cannot hold a shape."""
    likely = pc.or_(pc.match_substring(texts, "bearer", ignore_case=True), pc.match_substring(texts, "://"))
    return _with_rows(texts, np.flatnonzero(pc.fill_null(likely, False).to_numpy(zero_copy_only=False)), shapes)


def _by_parts(texts: pa.Array, fn) -> pa.Array:
    """``fn`` of every text, a few at a time, so that few are Python objects at once."""
    parts = [pa.array([None if s is None else fn(s) for s in texts.slice(lo, 256).to_pylist()], texts.type)
             for lo in range(0, len(texts), 256)]
    return pa.concat_arrays(parts) if parts else texts


def _json_scrub(text):
    """A function that applies ``text`` to every string of a JSON text; keys stay."""
    import json

    def walk(v):
        if isinstance(v, str):
            return text(v)
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    def one(s):
        try:
            return json.dumps(walk(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text(s)  # not JSON: scrub it as plain text
    return one
