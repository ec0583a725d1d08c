"""Readers and writers: packets, alert logs, files, relational tables, event sinks."""
