"""Leases of background work, gates that hold it back, and how vectors of two models differ."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np


class Lease(NamedTuple):
    holder: str
    token: int
    expires: float


def acquire(current: Lease | None, holder: str, now: float, seconds: float) -> tuple[Lease | None, bool]:
    """(lease, got it): a lease is free if there is none or it has run out; each holder's token is
    greater than the one before, so that writes of a lost lease can be told."""
    if current is not None and current.expires > now and current.holder != holder:
        return current, False
    return Lease(holder, (current.token if current else 0) + 1, now + seconds), True


def renew(current: Lease | None, token: int, now: float, seconds: float) -> tuple[Lease | None, bool]:
    """Longer, if the token is the current one and it hasn't run out."""
    if current is None or current.token != token or current.expires <= now:
        return current, False
    return current._replace(expires=now + seconds), True


def release(current: Lease | None, token: int) -> Lease | None:
    """No lease, if the token is the current one."""
    return None if current is not None and current.token == token else current


def gate(hour: int, first: int, last: int, recent: int, most_recent: int) -> str | None:
    """Why heavy work doesn't run now: outside its hours, or too many lookups of late."""
    inside = first == last or (first <= hour < last if first < last else hour >= first or hour < last)
    return "outside_window" if not inside else "query_rate_high" if recent > most_recent else None


def margins(vectors: dict[str, Sequence[float]], pairs: list[tuple[str, str, str]]) -> list[float]:
    """Of each (text, near, far): how much more like the near text it is than the far one."""

    def cosine(a: Sequence[float], b: Sequence[float]) -> float:
        n = min(len(a), len(b))
        x, y = np.asarray(a[:n], dtype=float), np.asarray(b[:n], dtype=float)
        size = float(np.linalg.norm(x) * np.linalg.norm(y))
        return float(x @ y) / size if size else 0.0

    return [cosine(vectors[t], vectors[near]) - cosine(vectors[t], vectors[far]) for t, near, far in pairs]


def canary(now: list[float], baseline: list[float], drift: list[float]) -> bool:
    """Whether an embedder is sound: every margin at least 0.1 and half of its baseline, every probe
    at least 0.98 like itself before."""
    return all(m >= max(0.1, 0.5 * b) for m, b in zip(now, baseline, strict=True)) and all(d >= 0.98 for d in drift)
