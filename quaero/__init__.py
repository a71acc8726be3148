"""Retrieval and answer evaluation over whole tables, written as Spark DataFrame operators."""

from quaero.params import Params

__all__ = ["Params"]
