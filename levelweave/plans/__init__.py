"""Plan helpers: lineage cuts, checked broadcasts, skewed keys."""
