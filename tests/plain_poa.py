"""The consensus of one window with plain loops over the graph and the whole table, to hold the batched one against."""

from __future__ import annotations

import numpy as np

from tessera.operators.poa import phred, trimmed


class Graph:
    """base: letter codes; ins: {predecessor: weight} of each node; twins: nodes of other letters in the same place;
    place: where along the backbone a node belongs; reads: sequences through it."""

    def __init__(self, backbone: bytes, weights: np.ndarray):
        self.base = list(backbone)
        n = len(self.base)
        self.ins: list[dict[int, int]] = [{} for _ in range(n)]
        self.outs: list[list[int]] = [[] for _ in range(n)]
        self.twins: list[list[int]] = [[] for _ in range(n)]
        self.place = list(range(n))
        self.reads = [1] * n
        for i in range(1, n):
            self._edge(i - 1, i, int(weights[i - 1] + weights[i]))

    def _edge(self, a: int, b: int, weight: int) -> None:
        if a not in self.ins[b]:
            self.outs[a].append(b)
        self.ins[b][a] = self.ins[b].get(a, 0) + weight

    def order(self) -> list[int]:
        """The nodes so that predecessors come first."""
        waits = [len(x) for x in self.ins]
        ready = [i for i in range(len(waits) - 1, -1, -1) if not waits[i]]
        out = []
        while ready:
            node = ready.pop()
            out.append(node)
            for after in self.outs[node]:
                waits[after] -= 1
                if not waits[after]:
                    ready.append(after)
        return out

    def align(self, sequence: np.ndarray, first: int, last: int, match: int, mismatch: int, gap: int) -> list[tuple[int, int]]:
        """Pairs (node or -1, position or -1) of the sequence against the nodes whose place is first..last."""
        nodes = [v for v in self.order() if first <= self.place[v] <= last]
        row_of = {v: i for i, v in enumerate(nodes, 1)}
        m = len(sequence)
        slope = np.arange(m + 1, dtype=np.int32) * gap
        table = np.empty((len(nodes) + 1, m + 1), np.int32)
        table[0] = slope
        score = {b: np.where(sequence == b, match, mismatch).astype(np.int32) for b in set(self.base)}
        before: list[list[int]] = [[]]
        for i, v in enumerate(nodes, 1):
            rows = [row_of[p] for p in self.ins[v] if p in row_of] or [0]
            before.append(rows)
            own, row = score[self.base[v]], table[i]
            above = table[rows[0]]
            np.add(above, gap, out=row)
            np.maximum(row[1:], above[:-1] + own, out=row[1:])
            for r in rows[1:]:
                above = table[r]
                np.maximum(row, above + gap, out=row)
                np.maximum(row[1:], above[:-1] + own, out=row[1:])
            row -= slope
            np.maximum.accumulate(row, out=row)
            row += slope
        ends = [i for i, v in enumerate(nodes, 1) if not any(w in row_of for w in self.outs[v])]
        i, j = max(ends, key=lambda r: (table[r, m], -r)) if ends else 0, m
        path = []
        while i or j:
            here, v = table[i, j], nodes[i - 1] if i else -1
            if i and j:
                own = score[self.base[v]][j - 1]
                found = next((r for r in before[i] if table[r, j - 1] + own == here), None)
                if found is not None:
                    path.append((v, j - 1))
                    i, j = found, j - 1
                    continue
            if i:
                found = next((r for r in before[i] if table[r, j] + gap == here), None)
                if found is not None:
                    path.append((v, -1))
                    i = found
                    continue
            path.append((-1, j - 1))
            j -= 1
        return path[::-1]

    def add(self, path: list[tuple[int, int]], sequence: bytes, weights: np.ndarray, first: int) -> None:
        last, place = -1, first
        for node, at in path:
            if node >= 0:
                place = self.place[node]
            if at < 0:
                continue
            letter = sequence[at]
            here = -1
            if node >= 0:
                here = next((v for v in (node, *self.twins[node]) if self.base[v] == letter), -1)
            if here < 0:
                here = len(self.base)
                self.base.append(letter)
                self.ins.append({})
                self.outs.append([])
                self.place.append(place)
                self.reads.append(0)
                group = [node, *self.twins[node]] if node >= 0 else []
                self.twins.append(group)
                for v in group:
                    self.twins[v] = [*self.twins[v], here]
            self.reads[here] += 1
            if last >= 0:
                self._edge(last, here, int(weights[at - 1] + weights[at]))
            last = here

    def consensus(self) -> tuple[bytes, list[int]]:
        order = self.order()
        total, back = [0] * len(order), [-1] * len(order)
        for v in order:
            if self.ins[v]:
                back[v], weight = max(self.ins[v].items(), key=lambda x: (x[1], total[x[0]], -x[0]))
                total[v] = total[back[v]] + weight
        v = max(order, key=lambda x: (total[x], -x))
        tail = []
        end = v
        while self.outs[end]:  # on to where nothing follows
            end = max(self.outs[end], key=lambda x: (self.ins[x][end], total[x], -x))
            tail.append(end)
        path = []
        while v >= 0:
            path.append(v)
            v = back[v]
        path = path[::-1] + tail
        return bytes(self.base[v] for v in path), [self.reads[v] for v in path]


def window_consensus(backbone: str, backbone_quality: str, layers, match: int, mismatch: int, gap: int, trim: bool) -> str:
    """layers: in order, with begin, end (inclusive), data, quality."""
    graph = Graph(backbone.encode(), phred(backbone_quality, len(backbone)))
    edge = int(0.01 * len(backbone))
    for layer in layers:
        data = layer["data"].encode()
        whole = layer["begin"] < edge and layer["end"] > len(backbone) - edge
        first, last = (0, len(backbone) - 1) if whole else (layer["begin"], layer["end"])
        path = graph.align(np.frombuffer(data, np.uint8), first, last, match, mismatch, gap)
        graph.add(path, data, phred(layer["quality"], len(data)), first)
    consensus, coverage = graph.consensus()
    return (trimmed(consensus, coverage, len(layers)) if trim else consensus).decode()
