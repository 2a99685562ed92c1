"""Quarry: bulk analytics over a source-code archive, written for Spark."""
