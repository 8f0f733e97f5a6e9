"""Readers, versioned storage and record tables."""
