"""All registered queries."""

from __future__ import annotations

from . import catalog_bundles, catalog_geo, catalog_labels, catalog_models, catalog_reports, catalog_series, catalog_sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
