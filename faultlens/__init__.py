"""Root-cause analytics for telemetry incidents, written as Spark DataFrame jobs."""

from faultlens.session import build_session, prepare

__all__ = ["build_session", "prepare"]
