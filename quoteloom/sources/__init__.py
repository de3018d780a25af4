"""Readers and bindings that turn input tables and payloads into domain tables."""
