"""Continuous re-analysis of a growing source tree."""
