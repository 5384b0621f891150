"""Continuous arrival of snapshots."""
