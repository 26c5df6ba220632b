"""Interpolation by name."""

from lodegrid.operators.nodes import METHODS as INTERPOLATION_METHODS  # noqa: F401
from lodegrid.operators.nodes import Interpolate, Interpolator  # noqa: F401
