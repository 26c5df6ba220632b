"""Spark-native analytics over labelled, multi-dimensional observation data."""

from lodegrid.plans.coordinates import Coordinates, clinspace, crange  # noqa: F401
from lodegrid.plans.node import Node, NodeException  # noqa: F401
from lodegrid.plans.settings import settings  # noqa: F401

__version__ = "0.1.0"
