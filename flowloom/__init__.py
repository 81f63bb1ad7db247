"""flowloom: network-flow analytics as Spark jobs."""

from flowloom.settings import Settings

__all__ = ["Settings"]
