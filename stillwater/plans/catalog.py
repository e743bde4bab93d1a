"""Every query of the engine by name, with its equivalent SQL."""

from __future__ import annotations

from stillwater.plans import images, records

QUERIES = images.QUERIES | records.QUERIES
ORACLES = images.ORACLES | records.ORACLES
FLAGSHIP = "frame_metrics"
