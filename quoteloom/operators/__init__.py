"""Relational operators over quotes, markets, events, history and operations."""
