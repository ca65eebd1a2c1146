"""Spark-native document, retrieval and ranking operators."""

from tessaly.session import build_session, load_tables

__all__ = ["build_session", "load_tables"]
