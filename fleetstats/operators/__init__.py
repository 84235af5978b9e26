"""Statistics, history queries, snapshots and the repository catalogue."""
