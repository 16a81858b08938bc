"""Incremental packing as a stream of snapshots."""
