from scrubline.catalog import files, fills, frames, pixels, profiles, signals, tables, texts  # noqa: F401
from scrubline.catalog.registry import ORACLES, QUERIES  # noqa: F401
