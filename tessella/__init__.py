"""Sentence segmentation and training-data preparation over Spark DataFrames."""

from tessella.api import NormalizationResult, OffsetMap, Segmenter, TextSpan, disambiguate, normalize, normalize_with_map

__all__ = ["NormalizationResult", "OffsetMap", "Segmenter", "TextSpan", "disambiguate", "normalize", "normalize_with_map"]
