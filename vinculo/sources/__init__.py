"""Schemas, page text scans, grid scans, registry scans and sinks."""
