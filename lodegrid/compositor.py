"""Compositors by name."""

from lodegrid.operators.nodes import BaseCompositor, OrderedCompositor, TileCompositor  # noqa: F401
