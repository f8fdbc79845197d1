"""Operators for preparing training text: counting, cleaning, deduplicating, scoring, mixing and storing documents."""
