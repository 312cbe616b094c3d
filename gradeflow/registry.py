"""Named extension points."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


class Registry:
    """Names mapped to functions; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, Callable] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def keep(fn: Callable) -> Callable:
            if name in self._entries:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self._entries[name] = fn
            return fn

        return keep

    def get(self, name: str) -> Callable:
        if name not in self._entries:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {self.names()}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def __contains__(self, name: str) -> bool:
        return name in self._entries


loaders = Registry("loader")  # (spark, config) -> DataFrame
formatters = Registry("formatter")  # DataFrame -> DataFrame, for df.transform
analyzers = Registry("analyzer")  # results -> metrics DataFrame
tasks = Registry("task")  # (samples, responses) -> results


def run_analyzers(results: DataFrame, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Metrics by analyzer; an unknown name is logged and left out."""
    out = {}
    for name in analyzers.names() if names is None else names:
        if name not in analyzers:
            log.warning("analyzer %r is not registered; skipped", name)
            continue
        out[name] = analyzers.get(name)(results)
    return out
