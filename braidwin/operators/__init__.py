"""Positions, window joins and the building blocks around them."""
