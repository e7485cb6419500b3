"""Readers, writers and artefact storage."""
