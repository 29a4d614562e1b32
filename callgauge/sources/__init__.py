"""Readers, shapers and sinks."""
