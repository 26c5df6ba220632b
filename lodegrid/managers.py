"""Managers by name."""

from lodegrid.operators.managers import Parallel, ParallelAsync, ParallelOutput, Process  # noqa: F401
