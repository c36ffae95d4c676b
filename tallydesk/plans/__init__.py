"""Shapes of plans that keep every task small when a few keys hold most of the rows."""
