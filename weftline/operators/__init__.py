"""Relational operators: alignment, glossary joins, findings, terms, gate, drift."""
