"""Dependency graphs, which are small: cycle search and ordering on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def find_cycle(edges: dict) -> list | None:
    """A closed path of nodes, such as [1, 1] for a self-loop; None without one. An own stack, so depth is no limit."""
    state: dict = {}
    for root in sorted(edges):
        if root in state:
            continue
        path, stack = [root], [iter(sorted(edges.get(root, ())))]
        state[root] = 1
        while stack:
            for node in stack[-1]:
                if state.get(node) == 1:
                    return [*path[path.index(node) :], node]
                if node not in state:
                    state[node] = 1
                    path.append(node)
                    stack.append(iter(sorted(edges.get(node, ()))))
                    break
            else:
                state[path.pop()] = 2
                stack.pop()
    return None


def topo_order(edges: dict) -> list:
    """Nodes with their dependencies before them, smaller ids first among those that are ready."""
    if cycle := find_cycle(edges):
        raise ValueError(f"cycle: {cycle}")
    nodes = set(edges) | {d for v in edges.values() for d in v}
    left, users = {n: len(set(edges.get(n, ()))) for n in nodes}, {n: [] for n in nodes}
    for n, own in edges.items():
        for d in set(own):
            users[d].append(n)
    ready, order = [n for n, k in left.items() if not k], []
    heapq.heapify(ready)
    while ready:
        order.append(heapq.heappop(ready))
        for n in users[order[-1]]:
            left[n] -= 1
            if not left[n]:
                heapq.heappush(ready, n)
    return order


def finalize_order(edges: dict) -> list:
    return topo_order(edges)[::-1]


class Materializer:
    """compute(node, results of its inputs), at most once for each node; a cycle is an error when it is read."""

    def __init__(self, edges: dict, compute: Callable):
        self.edges, self.compute, self.done = edges, compute, {}

    def get(self, node):
        if node not in self.done:
            reach, todo = {}, [node]
            while todo:
                n = todo.pop()
                if n not in reach:
                    reach[n] = list(self.edges.get(n, ()))
                    todo += reach[n]
            for n in topo_order(reach):
                if n not in self.done:
                    self.done[n] = self.compute(n, [self.done[d] for d in reach[n]])
        return self.done[node]
