"""Engine settings: defaults, a JSON file, and temporary overrides."""

from __future__ import annotations

import json
from contextlib import contextmanager
from pathlib import Path

DEFAULTS: dict[str, object] = {
    "CACHE_PATH": "lodegrid-cache",
    "ENABLE_CACHE": True,
    "ENABLE_UNITS": True,
    "DEFAULT_CRS": "+proj=longlat +datum=WGS84 +no_defs +vunits=m",
    "CHUNK_SIZE": 1_048_576,
    "UNSAFE_EVAL": False,
    "DEBUG": False,
}


class Settings(dict):
    def __init__(self) -> None:
        super().__init__(DEFAULTS)

    def reset(self) -> None:
        self.clear()
        self.update(DEFAULTS)

    def load(self, path: str) -> None:
        self.update(json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self, indent=2, sort_keys=True))

    @contextmanager
    def override(self, **values: object):
        before = dict(self)
        self.update(values)
        try:
            yield self
        finally:
            self.clear()
            self.update(before)

    def require_unsafe(self) -> None:
        if not self["UNSAFE_EVAL"]:
            raise PermissionError("running code given as text is off; set UNSAFE_EVAL to allow it")


settings = Settings()
