"""Structured Streaming forms of the experiment results (orders arriving as files)."""

from splitlens.streaming.daily import daily_results_stream, orders_stream, run_daily_stream

__all__ = ["daily_results_stream", "orders_stream", "run_daily_stream"]
