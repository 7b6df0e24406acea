"""Connected components, as the core finds them."""

from corpuslab.operators.components import components

__all__ = ["components"]
