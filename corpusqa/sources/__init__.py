"""Readers, document builders and the versioned knowledge base."""
