"""Profile of JSON texts: which paths there are, of which types, how often, and an example."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an example, and levels that are looked at.
EXAMPLE, DEPTH = 80, 64
_PATHS = "path string, kind string, n long, example string"


def leaves(node: object, path: str = "", depth: int = 0) -> Iterator[tuple[str, object]]:
    """(path, value) of what isn't a list or block; of a list the first element, as the others are more of the same."""
    stack = [(node, path, depth)]
    while stack:
        node, path, depth = stack.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, dict):
            stack += [(v, f"{path}.{k}" if path else str(k), depth + 1) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(v, f"{path}[]", depth + 1) for v in node[:1]]
        else:
            yield path, node


def kind_of(value: object) -> str:
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def json_paths(df: DataFrame, text: Column, useful: str | None = None) -> DataFrame:
    """(path, kind, n, example) over all texts; ``useful``: a pattern that the last key of a path has to hold.

    A batch adds its own paths up before anything is shuffled, so a path costs a row for each batch and not for each text; counts add and
    examples are the least, so the result doesn't depend on how the texts are dealt. Texts that aren't JSON are counted under an empty
    path of kind ``invalid``; null texts aren't counted; null and empty values count as values of their kind.
    """
    wanted = re.compile(useful, re.IGNORECASE) if useful else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[tuple[str, str], list] = {}
            for t in b["text"]:
                try:
                    hits = leaves(json.loads(t))
                    hits = [(p, kind_of(v), v) for p, v in hits]
                except (ValueError, RecursionError):
                    hits = [("", "invalid", t)]
                for path, kind, v in hits:
                    if wanted is None or kind == "invalid" or wanted.search(path.rsplit(".", 1)[-1]):
                        example = (v if isinstance(v, str) else json.dumps(v))[:EXAMPLE]
                        entry = found.setdefault((path, kind), [0, example])
                        entry[0] += 1
                        entry[1] = min(entry[1], example)
            yield pd.DataFrame([(p, k, n, x) for (p, k), (n, x) in found.items()], columns=["path", "kind", "n", "example"])

    parts = df.select(text.alias("text")).where("text is not null").mapInPandas(run, _PATHS)
    return parts.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
