"""Realtime feeds through Structured Streaming."""
