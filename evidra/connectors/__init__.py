"""Edges of the engine: what fetches pages, asks models and searches. Each runs inside tasks, a domain at a time."""
