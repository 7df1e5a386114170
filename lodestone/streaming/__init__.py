"""Saturation of arriving facts."""

from lodestone.streaming.incremental import Saturation

__all__ = ["Saturation"]
