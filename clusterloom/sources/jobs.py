"""Spark jobs that do not wait for each other."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor


def side_by_side(calls: list[Callable]) -> list:
    """What the calls return, in their order, each run from a thread of its own, so that short jobs fill the cluster together.

    The first error of a call is raised once all have ended."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [found.result() for found in [pool.submit(call) for call in calls]]
