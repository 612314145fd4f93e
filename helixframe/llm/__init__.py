"""Operators for preparing large training corpora.

Nothing else in ``helixframe`` imports this subpackage; deleting it leaves the
rest of the engine intact.
"""
