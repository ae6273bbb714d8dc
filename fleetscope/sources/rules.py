"""Rule documents to the typed rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("id", "name", "severity", "metric", "condition", "threshold", "cooldown_sec", "escalate_to_fault", "enabled")


def typed_rules(raw: DataFrame) -> DataFrame:
    """Text fields to types; missing ones get name '', severity info, cooldown 60, no escalation, enabled."""
    have = set(raw.columns)
    c = lambda n: n if n in have else "cast(null as string)"
    return raw.selectExpr(
        "cast(id as string) as rule_id", f"coalesce({c('name')}, '') as name", f"coalesce({c('severity')}, 'info') as severity",
        "metric", "condition", "cast(threshold as double) as threshold", f"cast(coalesce({c('cooldown_sec')}, '60') as int) as cooldown_sec",
        f"cast(coalesce({c('escalate_to_fault')}, 'false') as boolean) as escalate",
        f"cast(coalesce({c('enabled')}, 'true') as boolean) as enabled")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a YAML rule file (a configuration file of a few rules) into the typed rule table."""
    import yaml

    with open(path, encoding="utf-8") as f:
        docs = (yaml.safe_load(f) or {}).get("rules", [])
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    rows = [tuple(text(d.get(k)) for k in FIELDS) for d in docs]
    return typed_rules(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in FIELDS)))
