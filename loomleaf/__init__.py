"""Spark-first analytics over linked Markdown-style documents."""
