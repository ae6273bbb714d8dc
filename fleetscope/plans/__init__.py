"""Query registry; importing the plan modules fills it."""

from fleetscope.plans.registry import ORACLES, QUERIES  # noqa: F401
from fleetscope.plans import q_telemetry, q_rules, q_crash_text, q_crash_graph, q_retrieval, q_fleet, q_streaming  # noqa: F401,E402
