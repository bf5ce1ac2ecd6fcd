"""Declarative rules and the packs built from them."""
