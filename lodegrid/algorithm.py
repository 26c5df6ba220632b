"""Algorithms by name."""

from lodegrid.operators.nodes import Algorithm, Arithmetic, BetaFitDayOfYear, Combine, Convolution, Count, DayOfYear, DayOfYearWindow, ExpandCoordinates, Generic, GroupReduce, Kurtosis, Mask, Max, Mean, Median, Min, ModifyCoordinates, Percentile, Reduce, Reproject, ResampleReduce, SelectCoordinates, Skew, StandardDeviation, Sum, TransformTimeUnits, UnaryAlgorithm, Variance, YearSubstituteCoordinates  # noqa: F401
from lodegrid.sources.nodes import Arange, CoordData, SinCoords  # noqa: F401
