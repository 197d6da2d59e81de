"""Running aggregates over unbounded streams."""
