"""Micro-batch forms of the upserts."""
