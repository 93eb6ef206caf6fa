"""Every query of the telemetry operators by name, and the SQL that gives the same rows."""

from __future__ import annotations

from rootloom.plans import check_queries, evaluation_queries, finding_queries, fit_queries, fusion_queries, graph_queries, opinion_queries, source_queries, streaming_queries, time_queries  # noqa: F401
from rootloom.plans.registry import ORACLES, QUERIES  # noqa: F401
