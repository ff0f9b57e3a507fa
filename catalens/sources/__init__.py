"""Readers, writers, cached payloads and digests."""
