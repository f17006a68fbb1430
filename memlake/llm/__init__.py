"""Training-data operators: each module is one operator of the corpus toolkit.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
