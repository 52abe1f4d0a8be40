"""Check kinds: an evaluator per kind, open for extension."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Snapshot:
    """What checks run against: tables by name, and captured files, responses and command output.

    ``partitions`` names the time column by which a table is stored in parts, ``components`` what is installed.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    files: DataFrame | None = None
    responses: DataFrame | None = None
    captures: DataFrame | None = None
    name: str = "snapshot"
    partitions: dict[str, str] = field(default_factory=dict)
    components: tuple[str, ...] = ()


Evaluator = Callable[[SparkSession, DataFrame, Snapshot, object], DataFrame]
_KINDS: dict[str, Evaluator] = {}


def register_check_kind(name: str, fn: Evaluator) -> None:
    """Register ``fn(spark, checks_df, snapshot, as_of) -> results_df`` for checks of kind ``name``."""
    if not name:
        raise ValueError("a check kind needs a name")
    if name in _KINDS:
        raise ValueError(f"check kind {name!r} is already registered")
    _KINDS[name] = fn


def check_kinds() -> dict[str, Evaluator]:
    return dict(_KINDS)
