"""basketry: commerce analytics marts, metrics, checks and anomaly detection on Spark."""

from .session import build_session

__all__ = ["build_session"]
