"""The perturbed A-star search of ``sentencepiece_sampling`` for many texts at a time, in numpy.

The lattices of all distinct units of a batch are built together: a trie walk from every
character at once, then the sums over the rest of a unit, units of equal rest together. In each
round every text splits its best region: all units of all texts draw their next edge together.

Shares and log-probabilities are kept as integers (40 and 36 bits behind the point), whose sums
don't depend on their order, and each draw is a hash of the text's seed, the round and the
character it is made at. So a text's samples don't depend on the batch it comes in.
"""

from __future__ import annotations

import math

import numpy as np

SHARE_BITS, LOG_BITS = 40, 36
KEPT_UNITS = 120_000  # lattices kept from batch to batch; beyond it the next batch starts anew
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
EDGES, SPLITS = 0, 1  # what a draw is for


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seeds: np.ndarray, turn: int, purpose: int) -> np.ndarray:
    """Seeds of the draws of a round for one purpose."""
    return mixed(seeds + np.array([2 * turn + purpose + 1], np.uint64) * GOLDEN)


def drawn(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 random bits for each place."""
    return mixed(seeds + (places + 1).astype(np.uint64) * GOLDEN)


def open_unit(bits: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (``lengths[0]`` of them), then the same for the next start."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Trie:
    """All pieces as ``state << 21 | character -> state``, sorted."""

    def __init__(self, known: dict[str, tuple[int, float]]):
        steps: dict[int, int] = {}
        piece, score = [-1], [0.0]
        for text, (number, log_p) in known.items():
            state = 0
            for c in text:
                step = state << 21 | ord(c)
                if step not in steps:
                    steps[step] = len(piece)
                    piece.append(-1)
                    score.append(0.0)
                state = steps[step]
            piece[state], score[state] = number, log_p
        self.steps = np.array(sorted(steps), np.int64)
        self.states = np.array([steps[s] for s in self.steps.tolist()], np.int64)
        self.piece, self.score = np.array(piece, np.int64), np.array(score)


class Lattices:
    """Lattices of units, one node a character, the edges of a node in a row.

    ``first_edge`` has the first edge of each node. An edge has ``keys`` (node and running share as
    one number), ``to`` (the node it leads to, -1 at the end), ``symbol`` (a piece, or ``-1 - c`` for
    the bytes of character ``c``), ``log_p`` as an integer, and ``rest``, the log of all other shares.
    """

    def __init__(self, known: dict[str, tuple[int, float]], byte_cost: float):
        self.trie, self.byte_cost = Trie(known), byte_cost
        self.clear()

    def clear(self) -> None:
        self.first_node: dict[str, int] = {}
        self.first_edge = np.zeros(1, np.int64)
        self.keys, self.to, self.symbol, self.log_p = (np.zeros(0, np.int64) for _ in range(4))
        self.rest = np.zeros(0)

    def nodes_of(self, units: list[str]) -> np.ndarray:
        """First nodes of the units; those not met yet are built."""
        if len(self.first_node) > KEPT_UNITS:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.first_node]
        if new:
            self._build(new)
        return np.array(list(map(self.first_node.__getitem__, units)), np.int64)

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``node, length, symbol, score`` of all edges; a character without a piece of its own stands as its bytes."""
        trie, found = self.trie, []
        nodes, state, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        alone = np.zeros(len(codes), bool)
        while len(nodes):
            step = state << 21 | codes[nodes + length]
            at = np.minimum(np.searchsorted(trie.steps, step), len(trie.steps) - 1)
            met = trie.steps[at] == step
            nodes, state, length = nodes[met], trie.states[at[met]], length + 1
            whole = trie.piece[state] >= 0
            ends = state[whole]
            if length == 1:
                alone[nodes[whole]] = True
            found.append((nodes[whole], np.full(len(ends), length), trie.piece[ends], trie.score[ends]))
            more = left[nodes] > length
            nodes, state = nodes[more], state[more]
        raw = np.flatnonzero(~alone)
        c = codes[raw]
        size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        found.append((raw, np.ones(len(raw), np.int64), -1 - c, size * self.byte_cost))
        return tuple(map(np.concatenate, zip(*found)))

    def _build(self, units: list[str]) -> None:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array(list(map(len, units)), np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        node, length, symbol, score = self._edges(codes, left)

        # Sums over the rest of a unit, from its last character on: edges lie by the characters left, then by node.
        order = np.argsort((left[node] * len(codes) + node) * (length.max() + 1) + length)
        node, length, symbol, score = node[order], length[order], symbol[order], score[order]
        total, value = np.zeros(len(codes) + 1), np.empty(len(node))
        leads_on = left[node] > length
        groups = np.flatnonzero(np.diff(left[node], prepend=0, append=-1))
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        first_of_group = np.searchsorted(starts, groups)
        for g in range(len(groups) - 1):
            lo, hi = groups[g], groups[g + 1]
            cuts = starts[first_of_group[g] : first_of_group[g + 1]]
            at, own = cuts - lo, node[cuts]
            v = score[lo:hi] + np.where(leads_on[lo:hi], total[node[lo:hi] + length[lo:hi]], 0.0)
            top = np.maximum.reduceat(v, at)
            per_node = np.diff(np.append(at, hi - lo))
            total[own] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, per_node)), at))
            value[lo:hi] = v
        order = np.argsort(node, kind="stable")  # by node, and by length in it
        node, length, symbol, leads_on = node[order], length[order], symbol[order], leads_on[order]
        log_p = value[order] - total[node]
        share = np.exp(log_p)
        first_edge = np.searchsorted(node, np.arange(len(codes)))
        per_node = np.diff(np.append(first_edge, len(node)))
        with np.errstate(divide="ignore"):
            rest = np.where(per_node[node] > 1, np.log(np.maximum(1.0 - share, 1e-300)), -np.inf)
        whole = np.int64(1) << SHARE_BITS
        run = np.cumsum(np.rint(share * whole).astype(np.int64))
        run -= np.repeat(run[first_edge] - np.rint(share[first_edge] * whole).astype(np.int64), per_node)
        run = np.minimum(run, whole)
        run[first_edge + per_node - 1] = whole

        nodes, edges = len(self.first_edge) - 1, len(self.keys)
        self.first_node.update(zip(units, (nodes + ends - sizes).tolist()))
        self.first_edge = np.concatenate((self.first_edge[:-1], first_edge + edges, [edges + len(node)]))
        self.keys = np.concatenate((self.keys, (node + nodes) * whole + run))
        self.to = np.concatenate((self.to, np.where(leads_on, node + length + nodes, -1)))
        self.symbol = np.concatenate((self.symbol, symbol))
        self.log_p = np.concatenate((self.log_p, np.rint(log_p * 2.0**LOG_BITS).astype(np.int64)))
        self.rest = np.concatenate((self.rest, rest))

    def draw(self, nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """An edge of each node by its share."""
        aim = nodes * (np.int64(1) << SHARE_BITS) + (bits >> np.uint64(64 - SHARE_BITS)).astype(np.int64)
        edge = self.first_edge[nodes]
        behind = np.flatnonzero(self.keys[edge] <= aim)
        while len(behind):
            edge[behind] += 1
            behind = behind[self.keys[edge[behind]] <= aim[behind]]
        return edge

    def draw_other(self, node: int, closed: tuple[int, ...], bits: int) -> tuple[int, float]:
        """An edge of a node beside the closed ones, and the log of the share of those that still stay."""
        left = [e for e in range(self.first_edge[node], self.first_edge[node + 1]) if e not in closed]
        shares = [math.exp(self.log_p[e] * 2.0**-LOG_BITS) for e in left]
        mass = sum(shares)
        aim, chosen = bits * 2.0**-64 * mass, len(left) - 1
        for i, share in enumerate(shares):
            aim -= share
            if aim < 0:
                chosen = i
                break
        others = sum(s for i, s in enumerate(shares) if i != chosen)
        return left[chosen], math.log(others) if others > 0 else -math.inf


def search(lattices: Lattices, units: list[list[str]], seeds: list[int], k: int) -> tuple[np.ndarray, ...]:
    """``text, rank, symbols, offsets, log p, inclusion`` of up to ``k`` segmentations of each text, by text and rank.

    A text is a list of units, empty for an empty text; ``offsets`` cut ``symbols`` into segmentations.
    """
    n = len(units)
    seeds = np.array(seeds, np.uint64)
    flat = [u for own in units for u in own]
    n_units = np.array(list(map(len, units)), np.int64)
    unit_end = np.cumsum(n_units)
    unit_node = lattices.nodes_of(flat) if flat else np.zeros(0, np.int64)
    sizes = np.array(list(map(len, flat)), np.int64)
    # The character a unit starts at, counted within its text.
    place = np.cumsum(sizes) - sizes
    if len(flat):
        has = n_units > 0
        place -= np.repeat(place[(unit_end - n_units)[has]], n_units[has])

    # A region: (value, start in the pool of the path it leaves, edges kept of it, unit, node, closed edges, log p so far)
    firsts = -np.log(-np.log(open_unit(drawn(seeded(seeds, 0, SPLITS), np.full(n, -1)))))
    regions = [[(v, 0, 0, e - m, unit_node[e - m] if m else -1, (), 0)] for v, e, m in zip(firsts.tolist(), unit_end.tolist(), n_units.tolist())]
    for t in np.flatnonzero(n_units == 0).tolist():
        regions[t] = []
    pool = np.zeros(0, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # per text: start and length in the pool, log p
    limit = np.full(n, -np.inf)
    for turn in range(k):
        texts = [t for t in range(n) if regions[t]]
        if not texts:
            break
        best = [max(regions[t]) for t in texts]
        for t, region in zip(texts, best):
            regions[t].remove(region)
        value, start, kept, unit, node, closed, before = zip(*best)
        texts, value, start, kept, unit = np.array(texts), np.array(value), np.array(start), np.array(kept), np.array(unit)

        # One walker a unit from the region's on; the first one goes on from the region's node.
        walks = unit_end[texts] - unit
        walker = ranges(unit, walks)
        text_of_walker = np.repeat(np.arange(len(texts)), walks)
        first = np.cumsum(walks) - walks
        at = unit_node[walker]
        at[first] = node
        who, unit_place = np.arange(len(walker)), place[walker] - unit_node[walker]
        unit_seed = seeded(seeds[texts], turn, EDGES)[text_of_walker]
        steps = []
        while len(who):
            here = unit_place[who] + at
            bits = drawn(unit_seed[who], here)
            edge = lattices.draw(at, bits)
            if not steps:
                forced = {}
                for i, shut in enumerate(closed):
                    if shut:
                        edge[first[i]], forced[i] = lattices.draw_other(node[i], shut, int(bits[first[i]]))
            steps.append((who, edge, at, here))
            to = lattices.to[edge]
            on = to >= 0
            who, at = who[on], to[on]
        # By walker, and by step of it.
        n_steps = np.bincount(np.concatenate([w for w, *_ in steps]), minlength=len(walker))
        offset = np.cumsum(n_steps) - n_steps
        who = np.repeat(np.arange(len(walker)), n_steps)
        edge, at, here = (np.empty(len(who), np.int64) for _ in range(3))
        for step, (w, *found) in enumerate(steps):
            to = offset[w] + step
            edge[to], at[to], here[to] = found
        text = text_of_walker[who]
        lengths = np.bincount(text, minlength=len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        logs = lattices.log_p[edge]
        rests = lattices.rest[edge]
        for i, rest in forced.items():
            rests[starts[i]] = rest
        upto = np.cumsum(logs)
        upto += np.repeat(np.array(before, np.int64) - (upto[starts] - logs[starts]), lengths)

        # The whole path goes to the pool: what is kept of the one it left, then the new edges.
        wholes = kept + lengths
        at_pool = len(pool) + np.cumsum(wholes) - wholes
        grown = np.concatenate((pool, np.empty(wholes.sum(), np.int64)))
        grown[ranges(at_pool, kept)] = pool[ranges(start, kept)]
        grown[ranges(at_pool + kept, lengths)] = edge
        pool = grown
        for t, s, m, p in zip(texts.tolist(), at_pool.tolist(), wholes.tolist(), upto[ends - 1].tolist()):
            out[t].append((s, m, p))

        # Regions of the paths that leave it at each edge; no more than could still be taken, and one for the limit.
        room = k - turn
        spots = (upto - logs) * 2.0**-LOG_BITS + rests
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            chance = np.log(-np.log(open_unit(drawn(seeded(seeds[texts], turn, SPLITS)[text], here))))
            bounded = spots - np.logaddexp(spots - value[text], chance)
        floor = np.array([min(regions[t])[0] if len(regions[t]) >= room else -np.inf for t in texts.tolist()])
        alive = np.flatnonzero(bounded > floor[text])
        alive = alive[np.argsort(-bounded[alive])]
        alive = alive[np.argsort(text[alive].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]  # by radix
        owner = text[alive]
        alive = alive[np.arange(len(alive)) - np.searchsorted(owner, owner) < room]
        own = text[alive]
        leaves = kept[own] + alive - starts[own]
        rows = zip(own.tolist(), bounded[alive].tolist(), at_pool[own].tolist(), leaves.tolist(), walker[who[alive]].tolist(), at[alive].tolist(), edge[alive].tolist(), (upto - logs)[alive].tolist(), (alive == starts[own]).tolist())
        numbers = texts.tolist()
        for i, v, s, m, u, x, e, p, at_start in rows:
            regions[numbers[i]].append((v, s, m, u, x, (*closed[i], e) if at_start else (e,), p))
        for t in numbers:
            if len(regions[t]) > room:
                regions[t] = sorted(regions[t], reverse=True)[:room]
    for t in range(n):
        if regions[t]:
            limit[t] = max(regions[t])[0]
        if not out[t]:
            out[t].append((0, 0, 0))
    counts = np.array(list(map(len, out)), np.int64)
    found = np.array([s for own in out for s in own], np.int64).reshape(-1, 3)
    text = np.repeat(np.arange(n), counts)
    log_p = found[:, 2] * 2.0**-LOG_BITS
    with np.errstate(over="ignore"):
        inclusion = np.where(np.isfinite(limit[text]), -np.expm1(-np.exp(np.minimum(log_p - limit[text], 50.0))), 1.0)
    symbols = lattices.symbol[pool[ranges(found[:, 0], found[:, 1])]]
    return text, ranges(np.zeros(n, np.int64), counts), symbols, np.append(0, np.cumsum(found[:, 1])), log_p, inclusion
