"""Instrumentation: parsers that work alike on tables and on streams of log lines."""
