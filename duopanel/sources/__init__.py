"""Readers of panels and writers of results."""

from .files import read_leverages, read_panel, write_result

__all__ = ["read_leverages", "read_panel", "write_result"]
