"""Streaming form of the stateless classify path."""
