"""Structured Streaming: the detectors with keyed state, and sinks."""
