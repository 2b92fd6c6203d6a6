"""Readers and writers: raw pages, canonical tables, snapshots, exports."""
