"""Relational operators over episodes, streams and frames."""
