"""Row-local checks on streams."""

from .filters import filter_valid_stream, flag_valid_stream

__all__ = ["filter_valid_stream", "flag_valid_stream"]
