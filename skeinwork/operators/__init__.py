"""Nodes as DataFrame operations."""
