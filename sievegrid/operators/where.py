"""The filter language of searches: a tree of comparisons that becomes one condition, and reaches the scan as such.

``{"lang": "en"}`` compares for equality; ``{"n": {"$gte": 3, "$lt": 9}}`` holds several comparisons, all of which must hold, as
must all fields of one mapping; ``$and`` and ``$or`` take lists of trees.

Defined results: a column that is null has no value: it is unlike any value (``$ne``, ``$nin``) and fits no other comparison. No tree, or an
empty one, takes every row; ``$in`` of nothing takes none and ``$nin`` of nothing all, as do ``$or`` and ``$and`` of nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: (c != F.lit(v)) | c.isNull(),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "$nin": lambda c, v: ~c.isin(*v) | c.isNull() if v else F.lit(True),
}


def condition(tree: dict | None) -> Column:
    """The condition of a tree; fields are columns of the frame that it is put to."""
    parts: list[Column] = []
    for name, value in (tree or {}).items():
        if name in ("$and", "$or"):
            both = (lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b)
            parts.append(reduce(both, map(condition, value)) if value else F.lit(name == "$and"))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        else:
            for operator, operand in (value if isinstance(value, dict) else {"$eq": value}).items():
                if operator not in COMPARISONS:
                    raise ValueError(f"unknown comparison {operator}")
                parts.append(COMPARISONS[operator](F.col(name), operand))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
