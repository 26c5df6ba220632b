"""Sources by name."""

from lodegrid.operators.nodes import ReprojectedSource  # noqa: F401
from lodegrid.sources.nodes import CSV, H5PY, OGR, WCS, Array, DataSource, Dataset, Overviews, PyDAP, Rasterio, Table, Zarr, ZarrMemory  # noqa: F401
