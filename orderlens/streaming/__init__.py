"""Streaming: score arriving orders with the saved late-delivery model."""

from orderlens.streaming.scoring import ORDER_INPUT_SCHEMA, start_scoring_stream

__all__ = ["ORDER_INPUT_SCHEMA", "start_scoring_stream"]
