"""Operators for large training-data corpora (text, pages, vectors, chats).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
