"""Plan helpers: scratch tables that cut lineage, size-checked broadcasts."""
