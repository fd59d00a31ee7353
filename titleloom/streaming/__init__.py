"""Keyed state over time: batch forms and their Structured Streaming twins."""
