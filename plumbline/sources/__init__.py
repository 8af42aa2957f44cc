"""Readers: source files, graph JSON, results, commit logs, issues, synthetic graphs."""
