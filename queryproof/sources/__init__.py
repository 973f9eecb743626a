"""Readers and writers: JSON lines, statement XML, HTML, partitioned catalog, metadata, contracts."""
