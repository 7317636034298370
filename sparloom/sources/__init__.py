"""Readers, writers and file housekeeping."""
