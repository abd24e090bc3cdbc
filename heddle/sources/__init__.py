"""Readers and writers of versioned snapshots, strict JSON lines, and record schemas."""
