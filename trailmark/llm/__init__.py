"""Operators for large text, chat, vector and media tables.

Each module holds one operator with its own general interface; ``queries``
holds the thin queries that apply them to whole tables.
"""
