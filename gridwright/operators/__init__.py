"""Operators over grids, elements and edits."""
