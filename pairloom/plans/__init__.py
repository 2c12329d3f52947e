"""Plan helpers: lineage, fixtures, assembled feature plans."""
