"""Operators for preparing training data at corpus scale.

Nothing else in the package imports this subpackage. ``queries`` holds the
registered queries; each other module holds one operator with its own general
interface.
"""
