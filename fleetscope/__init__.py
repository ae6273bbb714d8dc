"""fleetscope: telemetry, crash and case analytics for process fleets, as Spark DataFrame operators."""
