"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
