"""Registry of event sources, extensible by the user."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from .feeds import intel_events
from .products import PRODUCTS, normalise
from .topics import quarantine


class SourceRegistry:
    """``name -> (input DataFrame -> canonical DataFrame)``; works on streams as well."""

    def __init__(self) -> None:
        self._sources: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, to_canonical: Callable[[DataFrame], DataFrame]) -> None:
        self._sources[name] = to_canonical

    def names(self) -> list[str]:
        return list(self._sources)

    def event_flow(self, inputs: dict[str, DataFrame]) -> DataFrame:
        """All given inputs as one event flow; columns a source lacks are NULL."""
        frames = [self._sources[name](df) for name, df in inputs.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def default_registry() -> SourceRegistry:
    registry = SourceRegistry()
    registry.register("products", lambda df: quarantine(normalise(df))[0])
    for topic in PRODUCTS:
        product = {topic: PRODUCTS[topic]}
        registry.register(topic, lambda df, p=product: quarantine(normalise(df, p))[0])
    registry.register("threat_intel", intel_events)
    return registry
