"""Readers and sinks with explicit schemas."""
