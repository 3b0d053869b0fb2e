"""Operators for preparing training text; nothing else in the library imports them.

Common rules. An operator takes a DataFrame and the names of its columns, reads
only those, and returns a table of its own columns: further columns of the
input, whatever their names, never clash with internal ones. A null text counts
as empty unless the operator says otherwise. An empty table gives an empty
table. An identifier names one document; rows that repeat an identifier are
treated as documents of their own.
"""
