"""Models sent to every task as plain arrays.

A broadcast value is pickled by reference to its class, which executors without a copy of this
package cannot resolve. So only the arrays of a model are broadcast; its classes travel
with the function that uses it.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark import Broadcast
from pyspark.sql import SparkSession


def _plain(value, kinds: dict[str, type]):
    if isinstance(value, list):
        return [_plain(v, kinds) for v in value]
    if not is_dataclass(value):
        return value
    kinds[type(value).__name__] = type(value)
    return {"kind": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name), kinds) for f in fields(value)}}


def _rebuilt(value, kinds: dict[str, type]):
    if isinstance(value, list):
        return [_rebuilt(v, kinds) for v in value]
    if isinstance(value, dict):
        return kinds[value["kind"]](**{name: _rebuilt(v, kinds) for name, v in value["fields"].items()})
    return value


class Sent:
    """A model on its way: ``value`` builds it in a task, around the arrays that the task's process has received."""

    def __init__(self, broadcast: Broadcast, kinds: dict[str, type]):
        self.broadcast, self.kinds, self.built = broadcast, kinds, None

    @property
    def value(self):
        if self.built is None:
            self.built = _rebuilt(self.broadcast.value, self.kinds)
        return self.built


def send(spark: SparkSession, model) -> Sent:
    """Broadcast a dataclass of arrays, lists and other such dataclasses."""
    kinds: dict[str, type] = {}
    plain = _plain(model, kinds)
    return Sent(spark.sparkContext.broadcast(plain), kinds)
