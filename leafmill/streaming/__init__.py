"""Resumable and streaming work."""
