"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Each module holds one operator with a general interface;
``registry`` derives from them the thin ``opN_<name>`` queries.
"""
