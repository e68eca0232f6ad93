"""Streams take the stateless operators as they are.

``selection`` (and ``range_selection`` without order) build the same plan over ``spark.readStream`` input as over a table, and
``aggregate`` runs with the update or complete output mode. There is no operator of streams alone.
"""

from larkspur.operators.relational import aggregate, range_selection, selection

__all__ = ["aggregate", "range_selection", "selection"]
