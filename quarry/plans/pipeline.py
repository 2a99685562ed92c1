"""Transforms in a row: what wraps an archive is a list of functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame

from quarry.errors import ArgumentError

Step = Callable[[DataFrame], DataFrame]


def pipeline(steps: Iterable[Step]) -> Step:
    return lambda df: reduce(lambda now, step: step(now), steps, df)


def build(config: list[dict], known: dict[str, Callable[..., Step]]) -> Step:
    """A pipeline from ``[{"cls": name, **options}, ...]``, the outermost first as rows meet them."""
    unknown = [c["cls"] for c in config if c["cls"] not in known]
    if unknown:
        raise ArgumentError(f"no such steps: {unknown}")
    return pipeline([known[c["cls"]](**{k: v for k, v in c.items() if k != "cls"}) for c in config])
