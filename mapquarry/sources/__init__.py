"""Readers, writers and the catalogue of extracts."""
