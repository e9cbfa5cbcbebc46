"""Hypergraph algorithms: each is a vertex and a hyperedge program, or a short plan."""

from weft.plans.components import connected_components
from weft.plans.labels import label_propagation
from weft.plans.neighbours import estimates, neighbour_counts, neighbour_registers
from weft.plans.pagerank import pagerank, pagerank_entropy, pagerank_graph, pagerank_on_graph
from weft.plans.paths import shortest_path
from weft.plans.walks import random_walk

__all__ = [
    "connected_components",
    "estimates",
    "label_propagation",
    "neighbour_counts",
    "neighbour_registers",
    "pagerank",
    "pagerank_entropy",
    "pagerank_graph",
    "pagerank_on_graph",
    "random_walk",
    "shortest_path",
]
