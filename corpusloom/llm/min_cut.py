"""Minimum cut of small undirected graphs with terminal costs."""

from __future__ import annotations

from collections import deque


def min_cut_labels(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True or False) of least total cost: costs[i] is what label True, label False costs node i,
    an edge (i, j, w) costs w if its ends differ. Ties go to False.

    A node whose own preference outweighs all its open edges has that label in every optimum; such nodes
    are settled first and their edges become terminal costs of their neighbours. Maximum flow by Dinic's
    method labels what is left.
    """
    n = len(costs)
    preference = [b - a for a, b in costs]  # above 0: True is cheaper
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            around[i].append((j, w))
            around[j].append((i, w))
    open_weight = [sum(w for _, w in a) for a in around]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(preference[i]) <= open_weight[i] + 1e-12 and open_weight[i] > 0:
            continue
        label[i] = preference[i] > 0
        for j, w in around[i]:
            if label[j] is None:
                preference[j] += w if label[i] else -w
                open_weight[j] -= w
                if open_weight[j] < 1e-12:
                    open_weight[j] = 0.0
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        place = {i: k for k, i in enumerate(left)}
        inner = [(place[i], place[j], w) for i, j, w in edges if i != j and w > 0 and i in place and j in place]
        for i, side in zip(left, _source_side([preference[i] for i in left], inner)):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(preference: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    n = len(preference)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(u: int, v: int, forward: float, backward: float) -> None:
        head[u].append(len(to))
        to.append(v)
        room.append(forward)
        head[v].append(len(to))
        to.append(u)
        room.append(backward)

    for i, p in enumerate(preference):
        if p > 0:
            connect(source, i, p, 0.0)
        elif p < 0:
            connect(i, sink, -p, 0.0)
    for i, j, w in edges:
        connect(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        while True:  # one augmenting path of the level graph after another, without recursion
            path: list[int] = []
            u = source
            while u != sink:
                while following[u] < len(head[u]):
                    e = head[u][following[u]]
                    if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                        break
                    following[u] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    u = to[e ^ 1]
                    following[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
