"""Relational, window, rollup and graph operators as DataFrame functions."""
