"""Readers, writers and source adapters."""
