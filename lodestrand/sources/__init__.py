"""Readers of files, paged services, evaluation cases and question sets, and keyed sinks."""
