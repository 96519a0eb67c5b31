"""Operators for building training corpora at scale.

One module per operator; ``registry`` maps query names to them.  Nothing
outside this subpackage imports it.
"""
