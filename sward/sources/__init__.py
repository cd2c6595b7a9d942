"""Readers, writers and input schemas."""
