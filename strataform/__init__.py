"""A PySpark engine for rollups over declared dimensions, and for insights on their snapshots."""
