"""Readers, streams and sinks."""
