"""Operators of a training-data pipeline: extraction, scoring, deduplication, decontamination, encoding.

Nothing outside this folder imports it. Modules are imported by name: ``from galleyproof.llm import decontam``.
"""
