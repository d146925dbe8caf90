"""Logs of changes as streams."""
