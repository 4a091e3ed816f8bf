"""Numbers of buckets and partitions derived from row counts."""

from __future__ import annotations


def power_of_two(n: float, least: int = 1) -> int:
    size = least
    while size < n:
        size *= 2
    return size
