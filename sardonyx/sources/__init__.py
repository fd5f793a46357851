"""Readers and writers (JSON lines, CSV, history JSON, model folders) and table bindings."""
