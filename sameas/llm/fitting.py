"""What the trained operators share: bounded samples, and score functions in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from sameas.llm.packing import blocks, pack


def by_hash(key: str, share: Column | float) -> Column:
    """Keeps about `share` of the rows, the same ones whenever it runs."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def bounded_share(n: int, limit: int) -> float:
    """Share of `n` rows that hardly ever gives fewer than `limit` or all of them."""
    return 1.0 if n <= limit else min(1.0, (limit + 4 * limit**0.5) / n)


def score_texts(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: str,
                lower: bool = False) -> DataFrame:
    """Adds columns to (id, text, ...) and drops the text. `score(bytes, offsets)`
    gets a block of whole texts; `outputs` is the schema of what it returns."""
    source = docs
    names = source.columns
    at = names.index("text")
    kept = [i for i in range(len(names)) if i != at]
    fields = ", ".join(f"`{names[i]}` {source.schema[i].dataType.simpleString()}" for i in kept)
    added = [(field.name, to_arrow_type(field.dataType)) for field in T.StructType.fromDDL(outputs).fields]
    types = [to_arrow_type(source.schema[i].dataType) for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = pack(batch.column(at), lower)
            for first, last in blocks(offsets):
                part = data[offsets[first]:offsets[last]]
                found = score(part, offsets[first:last + 1] - offsets[first])
                columns = [batch.column(i).slice(first, last - first).cast(t) for i, t in zip(kept, types)]
                columns += [pa.array(found[name], t) for name, t in added]
                yield pa.RecordBatch.from_arrays(columns, [names[i] for i in kept] + [name for name, _ in added])

    return source.mapInArrow(run, f"{fields}, {outputs}")


class Adam:
    """Plain Adam over a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.first, self.second = ([np.zeros_like(a) for a in arrays] for _ in range(2))

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        fix = (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (self.rate * fix) * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
