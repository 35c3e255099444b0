"""Prove on Spark that a replicated copy of event tables equals its source, and analyse both sides."""
