"""Registered queries: each operator over the given tables, with the same question in DuckDB SQL."""

from soundcheck.catalog import (checks, discovery, evidence, fleet, monitoring, redaction, sources,  # noqa: F401
                                streams, verdicts)
from soundcheck.catalog.base import ORACLE, QUERIES  # noqa: F401
