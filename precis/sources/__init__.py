"""Readers, writers and the shared folder for written intermediate tables."""
