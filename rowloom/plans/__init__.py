"""Whole flows: learn a table, generate rows of the same shape."""

from .synthesizer import Profile, Synthesizer

__all__ = ["Profile", "Synthesizer"]
