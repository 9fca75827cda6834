"""Models and other Python functions run over batches of rows, whose failures end in the rows that cause them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

ERROR = "struct<error_type:string,message:string>"


@dataclass(frozen=True)
class Plugin:
    """A function over batches: make() is called once a task, on the worker, and gives a function from a list of inputs to a list of results, one for each, of the type returns (DDL).

    An input is the value of the column, or a tuple of the values of several.
    """

    name: str
    make: Callable[[], Callable[[list], list]]
    returns: str
    batch: int = 64


def _told(e: BaseException) -> dict:
    return {"error_type": type(e).__name__, "message": str(e)}


def _one_by_one(run: Callable, inputs: list, kind: pa.DataType) -> list[dict]:
    out = []
    for x in inputs:
        try:
            (value,) = run([x])
            pa.array([value], kind)  # a result of another type is this row's error
            out.append({"value": value, "error": None})
        except Exception as e:  # noqa: BLE001  whatever a plug-in raises concerns its own row
            out.append({"value": None, "error": _told(e)})
    return out


def call(plugin: Plugin, *columns: Column | str) -> Column:
    """struct(value, error) of a plug-in on each row; error is null where it worked, value where it did not.

    A batch that fails, or whose results are not as many as its rows or not of the type, is run again row
    by row, and only rows that fail alone have an error. If the model can't be made, each row says so.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    returns = _parse_datatype_string(plugin.returns)
    kind = to_arrow_type(returns)
    error = StructType().add("error_type", StringType()).add("message", StringType())
    made, size, single = plugin.make, plugin.batch, len(columns) == 1
    shape = pa.struct([("value", kind), ("error", to_arrow_type(error))])

    @F.arrow_udf(StructType().add("value", returns).add("error", error))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            model, broken = made(), None
        except Exception as e:  # noqa: BLE001
            model, broken = None, _told(e)
        for batch in batches:
            out = []
            for at in range(0, len(batch), size):
                inputs = [tuple(x.values()) for x in batch.slice(at, size).to_pylist()]
                inputs = [x[0] for x in inputs] if single else inputs
                if broken:
                    out.append(pa.array([{"value": None, "error": broken}] * len(inputs), shape))
                    continue
                try:
                    values = list(model(inputs))
                    if len(values) != len(inputs):
                        raise ValueError(f"{len(values)} results for {len(inputs)} rows")
                    out.append(pa.array([{"value": v, "error": None} for v in values], shape))
                except Exception:  # noqa: BLE001
                    out.append(pa.array(_one_by_one(model, inputs, kind), shape))
            yield pa.concat_arrays(out) if out else pa.array([], shape)

    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return run(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(cols)]))
