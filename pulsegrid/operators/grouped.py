"""Sequential work inside bounded groups, many groups per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, types as T


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], fn: Callable,
               outputs: Sequence[T.StructField]) -> DataFrame:
    """Apply ``fn`` to the sorted ``inputs`` arrays of each group; it returns one array per output.

    Groups must be bounded (a slice, a block, a chain): a task holds one group and one batch at a time.
    Spark hashes the groups over tasks and sorts them; small groups share a batch, so none pays for a call
    of its own.
    """
    keys, inputs = list(keys), list(inputs)
    schema = T.StructType([*[df.schema[k] for k in keys], *outputs])
    names = [f.name for f in outputs]
    rows = df.select(*keys, *[c for c in dict.fromkeys([*order, *inputs]) if c not in keys]) \
        .repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        def apply(pdf, edges):
            results = [[] for _ in names]
            lengths = []
            columns = [pdf[c].to_numpy() for c in inputs]
            for a, z in zip(edges[:-1], edges[1:]):
                out = fn(*[c[a:z] for c in columns])
                lengths.append(len(out[0]))
                for held, part in zip(results, out):
                    held.append(part)
            data = {k: pdf[k].iloc[np.repeat(edges[:-1], lengths)].reset_index(drop=True) for k in keys}
            data |= {n: np.concatenate(r) if r else [] for n, r in zip(names, results)}
            return pd.DataFrame(data, columns=[*keys, *names])

        pending, last = [], None  # batches of the group that is still open, and its last row
        for pdf in batches:
            if not len(pdf):
                continue
            seen = pdf[keys] if last is None else pd.concat([last, pdf[keys]], ignore_index=True)
            fresh = np.zeros(len(seen), dtype=bool)
            for k in keys:
                c = seen[k]
                p = c.shift()
                fresh |= ((c != p) & ~(c.isna() & p.isna())).to_numpy()
            fresh[0] = last is None
            starts = np.flatnonzero(fresh) - (last is not None)
            last = pdf[keys].iloc[[-1]]
            if len(starts) == (not pending):
                pending.append(pdf)
                continue
            whole = pd.concat([*pending, pdf], ignore_index=True)
            ahead = len(whole) - len(pdf)
            edges = starts + ahead if not pending else np.append(0, starts + ahead)
            yield apply(whole, edges)
            pending = [whole.iloc[edges[-1]:].reset_index(drop=True)]
        if pending:
            whole = pd.concat(pending, ignore_index=True)
            yield apply(whole, np.array([0, len(whole)]))

    return rows.mapInPandas(run, schema)
