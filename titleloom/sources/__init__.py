"""Readers and writers for listing catalogues, payloads and pages."""
