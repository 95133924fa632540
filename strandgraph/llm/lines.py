"""Column helpers for texts as arrays of lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(lines: Column, gone: Column) -> Column:
    """`lines` without the places in `gone` (ascending, from 0): the runs between them, in one pass."""
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.try_element_at(gone, F.greatest(j, F.lit(1))) + 1)
    stops = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.transform(stops, lambda stop, j: F.slice(lines, start(j) + 1, stop - start(j))))


def hide(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """`docs` with columns that begin with an underscore renamed, so that an operator's own columns, which do,
    never meet them; the present names of the columns `named`; and the renaming that undoes it."""
    taken, new = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.startswith("_"):
            name = f"own{c}"
            while name.lower() in taken:
                name = f"own_{name}"
            taken.add(name.lower())
            new[c] = name
    return docs.withColumnsRenamed(new), [new.get(c, c) for c in named], {v: k for k, v in new.items()}
