"""Limits that belong to the query contract, and guards that are off unless asked for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    default_page: int = 100
    maximum_page: int = 500
    maximum_list: int = 1000
    maximum_depth: int = 32
    maximum_terms: int = 1000
    proposition_chars: int = 1000
    semantic_terms: int = 1


@dataclass(frozen=True)
class Guards:
    """Row guards for callers that want a refusal instead of a long query; None is no guard.

    With ``trusted_ids`` no source's ids are read to see that they are unique.
    """

    scan_rows: int | None = None
    joined_rows: int | None = None
    sorted_rows: int | None = None
    trusted_ids: bool = False
