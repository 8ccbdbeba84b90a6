"""Readers and writers for reports, requests, catalogues, verdict stores and text outputs."""
