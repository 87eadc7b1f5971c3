"""Compositions of operators: retrieval, chat, snapshot, ingest."""
