"""Readers and canonical panels."""
