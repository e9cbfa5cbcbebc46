"""Hypergraph analytics on PySpark DataFrames."""

from weft.model import Graph, HyperGraph
from weft.operators.combiners import Combiner, Fold, Mode, fields, largest, smallest, total
from weft.operators.superstep import AllExcept, ArrowProgram, Everyone, Only, Program, Send, Step

__all__ = [
    "AllExcept",
    "ArrowProgram",
    "Combiner",
    "Everyone",
    "Fold",
    "Graph",
    "HyperGraph",
    "Mode",
    "Only",
    "Program",
    "Send",
    "Step",
    "fields",
    "largest",
    "smallest",
    "total",
]
