"""Shared plan building blocks and the end-to-end investigation."""
