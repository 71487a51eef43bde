"""Daily entity panels on Spark: features, error metrics, intervals, validation and risk scores."""

from daypanel.session import build_session, durable, shared_folder

__all__ = ["build_session", "durable", "shared_folder"]
