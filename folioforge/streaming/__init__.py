"""Streams of page fetches and of probe outcomes."""

from folioforge.streaming.arrivals import arrivals_by_window, latest_fetches, open_circuits

__all__ = ["arrivals_by_window", "latest_fetches", "open_circuits"]
