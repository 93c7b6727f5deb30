"""Readers for landed files and landed source payloads."""
