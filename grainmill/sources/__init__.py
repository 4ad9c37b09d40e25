"""Reading, writing, reports and snapshots."""
