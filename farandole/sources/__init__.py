"""Feed readers and snapshots."""
