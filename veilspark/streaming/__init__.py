"""Incremental, restartable page processing."""
