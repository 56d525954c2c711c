"""Reusable relational building blocks: label lookups, first row per key, per-key MAX, ordered and
distinct lists, key restriction before a lookup is reduced."""
