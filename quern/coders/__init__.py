"""Ordered, invertible transforms of one typed column, their registry and pipelines."""

from quern.coders.base import Coder, Pipeline, Registry, default_registry
from quern.coders.codec import PRESETS, compress, compress_with, decompress, decompress_bare, default_stages

__all__ = ["PRESETS", "Coder", "Pipeline", "Registry", "compress", "compress_with", "decompress", "decompress_bare", "default_registry", "default_stages"]
