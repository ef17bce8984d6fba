"""Folds along ordered rows of a key, where each step needs the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, key: str, order: str, inputs: list[str], fields: str, step: Callable) -> DataFrame:
    """``rows`` with ``fields`` that a fold adds: ``step(state, *inputs)`` gives the next state and the fields of one row,
    beginning each key with a state of None. A key's rows come in order to one task, batch by batch, and only the state is
    carried, so memory doesn't grow with the key. Nulls reach ``step`` as None."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for b in batches:
            out = []
            values = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in (key, *inputs)]
            for k, *row in zip(*values, strict=True):
                if k != at:
                    at, state = k, None
                state, made = step(state, *row)
                out.append(made)
            yield pd.concat([b, pd.DataFrame(out, columns=names, index=b.index, dtype=object)], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + ", ".join("`{}` {}".format(*f.split()) for f in fields.split(", "))
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
