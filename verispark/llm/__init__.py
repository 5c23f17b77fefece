"""Training-data operators: thirteen modules, one per operator.

Nothing outside this package imports it, so it can be removed whole.
"""
