"""Limits and how they are read from an environment; checked when made, folded into plans as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

RASTERIZERS = ("pdfium", "pdftoppm")
GIB = 1024**3
#: Lowest and highest of each limit.
BOUNDS = {
    "dpi": (36, 600),
    "max_pages": (1, 1000),
    "timeout_s": (1, 600),
    "memory_bytes": (1, 64 * GIB),
    "tmpfs_bytes": (1, 64 * GIB),
    "max_input_bytes": (1, 64 * GIB),
    "max_width_px": (1, 262144),
    "max_height_px": (1, 262144),
}


@dataclass(frozen=True)
class Limits:
    timeout_s: int = 60
    memory_bytes: int = 8 * GIB
    tmpfs_bytes: int = GIB
    max_input_bytes: int = 100 * 1024**2
    max_pages: int = 50
    dpi: int = 150
    skip_blanks: bool = True
    disclose_internals: bool = False
    max_width_px: int = 32768
    max_height_px: int = 32768
    rasterizer: str = "pdfium"

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name}: {getattr(self, name)} is not in [{low}, {high}]")
        if self.rasterizer not in RASTERIZERS:
            raise ValueError(f"rasterizer: {self.rasterizer!r} is none of {RASTERIZERS}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "VELLUMETRY_", **given) -> Limits:
        """Named variables (prefix and the field in capitals), then ``given``. A bad number names its
        variable. Blanks are skipped unless a clear no is given; internals are shown only for a clear yes."""
        out: dict = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            word = raw.strip().lower()
            if f.name == "skip_blanks":
                out[f.name] = word not in ("0", "false", "no", "off")
            elif f.name == "disclose_internals":
                out[f.name] = word in ("1", "true", "yes", "on")
            elif f.name == "rasterizer":
                out[f.name] = word
            else:
                try:
                    out[f.name] = int(raw)
                except ValueError:
                    raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} is not a whole number") from None
        return cls(**out | given)
