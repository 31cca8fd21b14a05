"""Flows in small networks with whole capacities."""

from __future__ import annotations


class Flow:
    """Maximum flow by blocking flows on layers. Capacities may be raised between runs; a run goes on from the last."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, a: int, b: int, cap: int) -> int:
        """The number of a new edge; the flow on it is what ``cap`` of its counterpart (``^ 1``) holds."""
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def _layers(self, s: int, t: int) -> list[int]:
        layer, queue = [-1] * len(self.out), [s]
        layer[s] = 0
        for a in queue:
            for e in self.out[a]:
                if self.cap[e] > 0 and layer[self.to[e]] < 0:
                    layer[self.to[e]] = layer[a] + 1
                    queue.append(self.to[e])
        return layer

    def run(self, s: int, t: int) -> None:
        while (layer := self._layers(s, t))[t] >= 0:
            nxt = [0] * len(self.out)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    push = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if not self.cap[e])
                    v = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while nxt[v] < len(self.out[v]):
                    e = self.out[v][nxt[v]]
                    if self.cap[e] > 0 and layer[self.to[e]] == layer[v] + 1:
                        break
                    nxt[v] += 1
                else:
                    if v == s:
                        break
                    v = self.to[path.pop() ^ 1]
                    nxt[v] += 1
                    continue
                path.append(e)
                v = self.to[e]
