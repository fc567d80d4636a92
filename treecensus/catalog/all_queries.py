"""Imports every module that registers queries."""

from treecensus.catalog import (  # noqa: F401
    columns,
    contents,
    exchange,
    history,
    permissions,
    planning,
    searches,
    streams,
    summaries,
)
