"""Commerce analytics over relational, time-series, document, CSV and graph data on Spark."""

from souklens.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
