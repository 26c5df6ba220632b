"""Caches by name."""

from lodegrid.operators.caches import CacheControl, HashCache, MemoryStore, PartialCache, Store, cached_property  # noqa: F401
