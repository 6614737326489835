"""Readers, writers, zone maps, snapshots and the artifact sink."""
