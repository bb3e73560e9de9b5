"""SentencePiece encoding and decoding, with distinct sampled segmentations.

A text is cut into units (a run of spaces and what follows up to the next space); no piece of
the vocabulary crosses a unit's edge, so a text's segmentations are the products of its units'.
``encode`` gives the library's own segmentation. Sampling works on the lattice of all
segmentations into pieces, where a piece of merge rank r weighs ``(1 + r) ** -alpha`` (ranks of a
BPE vocabulary follow use, as in Zipf's law).

Distinct samples come from Gumbel top-k without replacement: a best-first (A*) search over sets
of segmentations. Each set in the frontier has a perturbed value, the maximum of the Gumbel
perturbations of its members, drawn from the set's total mass (known exactly from the lattice's
backward sums) and capped by its parent's value. The best set is taken, one member drawn, and the
rest of the set split by the first unit in which it departs. The k highest members come out in
order, each once. The next value in the frontier (kappa) gives every sample its inclusion score
``1 - exp(-exp(log_prob - kappa))``. All random numbers depend on the seed, the row key and the
place in the text only.

Defined results: null and empty texts have no tokens and no samples; a text with fewer than k
segmentations gives all of them, each with inclusion 1; repeated rows get equal samples; texts
are read whole; U+2581, which the vocabulary uses for the space, decodes as a space. Existing
columns with the names of the added ones are replaced, others pass through.
"""

from __future__ import annotations

import math
import os
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain, repeat
from random import Random
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.common import fresh, mix64, release_memory, slices

SPACE = "▁"
UNIT = re.compile("▁*[^▁]+|▁+")
#: Characters worked on together.
CHUNK = 4_000_000
#: Characters in a unit up to which plain sums are safe at any usual alpha.
PLAIN = 24
#: Units that occur twice or more in a run of texts whose tokens and lattice a task remembers, at most.
KEPT = 60_000
_MODELS: dict[tuple[str, float], Vocabulary] = {}


@dataclass
class Lattices:
    """The lattices of distinct units, end to end. Node ``start[u] + i`` lies before character i of unit u.

    The edges of a node lie together, the longest piece first. An edge is the number of its kind:
    a state of the trie, or beyond these a character spelt in bytes.
    """

    start: np.ndarray
    first: np.ndarray  # first edge of each node
    kind: np.ndarray
    beta: np.ndarray  # of each node: log of the weight of all ways to its unit's end
    share: np.ndarray  # of each edge: its probability at its node
    size: np.ndarray  # of a kind: characters
    weight: np.ndarray  # of a kind: log weight
    token: np.ndarray  # of a kind: token id, or -1 - entry of byte_ids
    byte_ids: list[tuple[int, ...]]

    def followed_by(self, other: Lattices) -> Lattices:
        """Both lattices end to end: the units of ``other`` are numbered on."""
        nodes, edges, pieces = len(self.beta) - 1, len(self.kind), len(self.size) - len(self.byte_ids)
        kind = np.where(other.kind >= pieces, other.kind + np.int32(len(self.byte_ids)), other.kind)
        byte_ids = self.byte_ids + other.byte_ids
        both = lambda a, b: np.concatenate([a, b[pieces:]])
        token = np.concatenate([self.token[:pieces], -1 - np.arange(len(byte_ids), dtype=np.int32)])
        return Lattices(
            np.concatenate([self.start, other.start + nodes]), np.concatenate([self.first[:nodes], other.first + np.int32(edges)]), np.concatenate([self.kind, kind]),
            np.concatenate([self.beta[:nodes], other.beta]), np.concatenate([self.share, other.share]), both(self.size, other.size), both(self.weight, other.weight), token, byte_ids,
        )

    def end(self, node: int, edge: int) -> int:
        return node + int(self.size[self.kind[edge]])

    def log_prob(self, node: int, edge: int) -> float:
        return float(self.weight[self.kind[edge]] + self.beta[self.end(node, edge)] - self.beta[node])

    def edges(self, node: int) -> range:
        return range(int(self.first[node]), int(self.first[node + 1]))

    def tokens(self, edge: int) -> tuple[int, ...]:
        t = int(self.token[self.kind[edge]])
        return (t,) if t >= 0 else self.byte_ids[-1 - t]

    def steps(self, unit: int) -> tuple[int, list[int], list[int], list[float]]:
        """Of a unit: its first edge, the edges before each of its nodes (from 0 on), and each edge's characters and log-probability."""
        node = int(self.start[unit])
        stop = int(self.start[unit + 1]) if unit + 1 < len(self.start) else len(self.beta) - 1
        first = self.first[node : stop + 1]
        kind = self.kind[first[0] : first[-1]]
        size, here = self.size[kind], np.repeat(np.arange(node, stop), np.diff(first))
        return int(first[0]), (first - first[0]).tolist(), size.tolist(), (self.weight[kind] + self.beta[here + size] - self.beta[here]).tolist()

    def log_mass(self, unit: int, path: tuple[int, ...]) -> float:
        """Log-probability of one segmentation of a unit."""
        return float(self.weight[self.kind[list(path)]].sum() - self.beta[self.start[unit]])


class Vocabulary:
    """The pieces of a model file as a trie of sorted keys."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        texts = {i: self.sp.id_to_piece(i) for i in plain}
        rank = {i: min(float(n), max(0.0, -self.sp.get_score(i))) for i in plain}
        self.byte_weight = -alpha * np.log(1.0 + n)
        self.lift = 2.6 * alpha
        letters = sorted({c for t in texts.values() for c in t})
        self.letter = np.zeros(0x110001, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        states: dict[str, int] = {"": 0}
        keys: list[tuple[int, int]] = []
        for t in texts.values():
            for j in range(1, len(t) + 1):
                if t[:j] not in states:
                    states[t[:j]] = len(states)
                    keys.append((states[t[: j - 1]] * self.width + int(self.letter[ord(t[j - 1])]), states[t[:j]]))
        keys.sort()
        self.keys, self.states = np.array([k for k, _ in keys], np.int64), np.array([s for _, s in keys], np.int64)
        self.piece, self.weight = np.full(len(states), -1, np.int64), np.full(len(states), -np.inf)
        for i, t in texts.items():
            if self.piece[states[t]] < 0:
                self.piece[states[t]], self.weight[states[t]] = i, -alpha * np.log(1.0 + rank[i])
        self.depth = np.zeros(len(states), np.int32)
        self.depth[list(states.values())] = [len(t) for t in states]
        self.lifted = np.exp(self.weight + self.lift * self.depth)
        self.root = np.full(self.width, -1, np.int32)
        self.root[self.keys[self.keys < self.width]] = self.states[self.keys < self.width]
        self.slots, self.slot_keys = self._slots()
        spelt = [texts[i].replace(SPACE, " ").encode() if i in texts else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            spelt[i] = bytes([b])
        self.octets = np.array([len(x) for x in spelt], np.int32)
        self.octet_start = np.cumsum(self.octets, dtype=np.int32) - self.octets
        self.octet_text = np.frombuffer(b"".join(spelt), np.uint8)
        self.kept: dict[str, int] = {}
        self.kept_sizes, self.kept_tokens = np.empty(0, np.int64), np.empty(0, np.int32)
        self.kept_lattices: Lattices | None = None
        self.kept_sound = self.sound = True

    def _slots(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash table with two places for each key, at most a quarter full."""
        bits = int(np.ceil(np.log2(max(16, 6 * len(self.keys)))))
        self.shift = np.uint64(64 - bits)
        slots, held = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int64)
        one, two = self._places(self.keys)
        for i in range(len(self.keys)):
            key, state, p = int(self.keys[i]), int(self.states[i]), int(one[i])
            for _ in range(500):
                old_key, old_state = int(held[p]), int(slots[p])
                held[p], slots[p] = key, state
                if old_key < 0:
                    break
                a, b = (int(x[0]) for x in self._places(np.array([old_key])))
                key, state, p = old_key, old_state, b if p == a else a
            else:
                raise RuntimeError("trie table did not settle")
        return slots, held

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            k = key.astype(np.uint64)
            return ((k * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64), ((k * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        key = state.astype(np.int64) * self.width + letter
        a, b = self._places(key)
        out = np.where(self.slot_keys[a] == key, self.slots[a], np.int32(-1))
        return np.where(self.slot_keys[b] == key, self.slots[b], out)

    def _backward(self, lat: Lattices, units: np.ndarray, lengths: np.ndarray, lifted: np.ndarray | None) -> None:
        """Fill in ``beta`` of the units, all at once, from their ends on.

        With ``lifted`` (weights as plain numbers, brought near 1 by a factor for each character) sums
        are plain: short units of known characters cannot leave the range of a double. Other
        units are summed as logarithms.
        """
        size = lengths[units]
        units = units[np.argsort(-size, kind="stable")]
        size = lengths[units]
        longer = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1))
        total = lat.beta if lifted is None else np.ones(len(lat.beta))
        for r in range(len(longer) - 2, -1, -1):
            node = lat.start[units[: longer[r]]] + r
            edge = lat.first[node]
            degree = lat.first[node + 1] - edge
            kind = lat.kind[edge]
            to = node + lat.size[kind]
            value = lat.weight[kind] + total[to] if lifted is None else lifted[kind] * total[to]
            for d in range(1, int(degree.max(initial=1))):
                more = np.flatnonzero(degree > d)
                kind = lat.kind[edge[more] + d]
                to = node[more] + lat.size[kind]
                if lifted is None:
                    value[more] = np.logaddexp(value[more], lat.weight[kind] + total[to])
                else:
                    value[more] += lifted[kind] * total[to]
            total[node] = value
            if lifted is not None:
                lat.beta[node] = np.log(value) - self.lift * (size[: longer[r]] - r)

    def tokens_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's tokens of units: how many of each, and all end to end."""
        coded = self.sp.encode([u.replace(SPACE, " ") for u in units], num_threads=1)
        for i in [i for i, u in enumerate(units) if not u]:
            coded[i] = [self.sp.piece_to_id(SPACE)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return sizes, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))

    def spells(self, units: list[str], tokens: np.ndarray) -> bool:
        """Whether the tokens of units, end to end, decode to just these units, each with the space that it begins with."""
        want = "".join([" " + u for u in units]).replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return _octets(self, tokens)[0] == want

    def keep(self, units: list[str], times: np.ndarray) -> None:
        """Remember the units met twice or more, while there is room."""
        known = len(self.kept)
        new = [units[i] for i in (np.flatnonzero(times[known:] > 1) + known)[: KEPT - known].tolist()]
        if not new:
            return
        sizes, tokens = self.tokens_of(new)
        self.kept_sound = self.kept_sound and self.spells(new, tokens)
        lattices = self.lattices(new)
        self.kept.update(zip(new, range(known, known + len(new)), strict=True))
        self.kept_sizes, self.kept_tokens = np.concatenate([self.kept_sizes, sizes]), np.concatenate([self.kept_tokens, tokens])
        self.kept_lattices = lattices if self.kept_lattices is None else self.kept_lattices.followed_by(lattices)

    def lattices_of(self, units: list[str]) -> Lattices:
        """The lattices of units that begin with the remembered ones."""
        if self.kept_lattices is None:
            return self.lattices(units)
        return self.kept_lattices.followed_by(self.lattices(units[len(self.kept) :]))

    def lattices(self, units: list[str]) -> Lattices:
        units = [SPACE + u for u in units]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        start = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        nodes = int((lengths + 1).sum())
        owner = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
        at = np.arange(len(points), dtype=np.int32) + owner
        code = np.full(nodes + 1, 0x110000, np.int32)
        code[at] = points
        letter = self.letter[code]
        state, here, depth = at, at, 0
        found: list[tuple[np.ndarray, np.ndarray]] = []  # by length of piece: nodes, states
        degree = np.zeros(nodes + 1, np.int32)
        while len(here):
            state = self.step(state, letter[here + depth]) if depth else self.root[letter[here]]
            live = state >= 0
            here, state = here[live], state[live]
            depth += 1
            hit = self.piece[state] >= 0
            found.append((here[hit], state[hit]))
            degree[here[hit]] += 1
        single = np.zeros(nodes + 1, bool)
        single[found[0][0] if found else []] = True
        bare = at[~single[at]]
        degree[bare] += 1
        first = np.zeros(nodes + 2, np.int32)
        np.cumsum(degree, out=first[1:])
        kind = np.empty(int(first[-1]), np.int32)
        free = first[:-1].copy()
        while found:
            here, state = found.pop()
            e = free[here]
            free[here] = e + 1
            kind[e] = state
        byte_ids: list[tuple[int, ...]] = []
        known: dict[int, int] = {}
        for c in code[bare].tolist():
            if c not in known:
                known[c] = len(byte_ids)
                byte_ids.append(tuple(self.bytes[b] for b in chr(c).encode("utf-8", "replace")))
        kind[free[bare]] = [len(self.piece) + known[c] for c in code[bare].tolist()]
        extra = len(byte_ids)
        size = np.concatenate([self.depth, np.ones(extra, np.int32)])
        weight = np.concatenate([self.weight, [len(x) * self.byte_weight for x in byte_ids]])
        token = np.concatenate([self.piece, -1 - np.arange(extra)]).astype(np.int32)
        lat = Lattices(start, first, kind, np.zeros(nodes + 1), np.empty(0), size, weight, token, byte_ids)
        rough = lengths > PLAIN
        rough[owner[~single[at]]] = True
        self._backward(lat, np.flatnonzero(~rough), lengths, self.lifted)
        self._backward(lat, np.flatnonzero(rough), lengths, None)
        node = np.repeat(np.arange(nodes + 1, dtype=np.int32), degree)
        lat.share = weight[kind] + lat.beta[node + size[kind]]
        lat.share -= lat.beta[node]
        np.exp(lat.share, out=lat.share)
        return lat


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = Vocabulary(path, alpha)
    return _MODELS[path, alpha]


@contextmanager
def lent(path: str, alpha: float) -> Iterator[Vocabulary]:
    """A vocabulary, with what it remembers, that the process keeps for its next task; one whose task failed is not kept.

    A function sent to an executor comes with new globals for each task, so the vocabulary lies in a module of its own. One at a time is kept.
    """
    kept = sys.modules.setdefault("pipeweave_kept", ModuleType("pipeweave_kept")).__dict__.setdefault("vocabularies", {})
    at = os.stat(path)
    name = path, alpha, at.st_mtime_ns, at.st_size
    vocab = kept.pop(name, None) or Vocabulary(path, alpha)
    yield vocab
    kept.clear()
    kept[name] = vocab


def units_of(text: str | None) -> list[str]:
    """The units of a text, without the space that each begins with; further spaces as U+2581."""
    if not text:
        return []
    if SPACE not in text:
        units = text.split(" ")
        if "" not in units:
            return units
    return [u[1:] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]


def row_seed(seed: int, key: object) -> int:
    return xxhash.xxh3_64_intdigest(str(key).encode("utf-8", "surrogatepass"), seed=seed & (2**64 - 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Walk:
    """One drawn segmentation of each of some units in a row."""

    tokens: np.ndarray
    token_start: np.ndarray  # of each unit, and the end
    log_prob: np.ndarray  # of each unit's segmentation


def walk(lat: Lattices, unit: np.ndarray, base: np.ndarray) -> Walk:
    """Draw a segmentation of each unit by its probability; ``base`` seeds each draw."""
    n = len(unit)
    node = lat.start[unit]
    edge, stop = lat.first[node], lat.first[node + 1]
    live: np.ndarray | slice = slice(None)  # the rows that go on: at first all of them
    count, log_prob = np.zeros(n, np.int32), -lat.beta[node]
    steps: list[tuple[np.ndarray | slice, np.ndarray]] = []
    width = np.array([1, *[len(b) for b in lat.byte_ids]], np.int32)
    step = 0
    while len(node):
        todo = np.flatnonzero(stop - edge > 1)
        last, spot = stop[todo] - 1, edge[todo]
        with np.errstate(over="ignore"):
            u = _uniform(base[live][todo] + np.uint64(step) * np.uint64(0x8CB92BA72F3D8DD7))
        while len(todo):
            # the probability of the edge is taken off until the number drawn is used up
            u -= lat.share[spot]
            further = np.flatnonzero((u > 0) & (spot < last))
            todo, last, spot, u = todo[further], last[further], spot[further] + 1, u[further]
            edge[todo] = spot
        kind = lat.kind[edge]
        log_prob[live] += lat.weight[kind]
        token = lat.token[kind]
        steps.append((live, token))
        count[live] += 1
        bare = np.flatnonzero(token < 0)
        if len(bare):
            count[bare if isinstance(live, slice) else live[bare]] += width[-token[bare]] - 1
        node = node + lat.size[kind]
        edge, stop = lat.first[node], lat.first[node + 1]
        more = np.flatnonzero(stop > edge)  # the last node of each unit has no edge
        live = more.astype(np.int32) if isinstance(live, slice) else live[more]
        node, edge, stop = node[more], edge[more], stop[more]
        step += 1
    token_start = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=token_start[1:])
    tokens = np.empty(int(token_start[-1]), np.int32)
    at = token_start[:-1].astype(np.int32)
    for rows, token in steps:
        place = at[rows]
        tokens[place] = token
        bare = np.flatnonzero(token < 0)
        for b, i in enumerate((-1 - token[bare]).tolist()):
            ids = lat.byte_ids[i]
            tokens[place[bare[b]] : place[bare[b]] + len(ids)] = ids
        if len(bare):
            at[bare if isinstance(rows, slice) else rows[bare]] += width[-token[bare]] - 1
        at[rows] += 1
    return Walk(tokens, token_start, np.minimum(log_prob, 0.0))


def path_of(lat: Lattices, unit: int, tokens: np.ndarray) -> tuple[int, ...]:
    """The edges of a unit that spell the tokens."""
    node, out, i, row = int(lat.start[unit]), [], 0, tokens.tolist()
    while i < len(row):
        e = next(e for e in lat.edges(node) if tuple(row[i : i + len(lat.tokens(e))]) == lat.tokens(e))
        out.append(e)
        node, i = lat.end(node, e), i + len(lat.tokens(e))
    return tuple(out)


def draw_other(lat: Lattices, unit: int, taken: list[tuple[int, ...]], rng: Random, mass: dict[tuple[int, ...], float] | None = None) -> tuple[int, ...] | None:
    """A segmentation of the unit outside ``taken``, by its probability among those. None: nothing is left.

    At every node the mass of the taken paths that still agree is left out (``mass``, of each of them, if it is known).
    """
    node, path, log_prob = 0, (), 0.0
    mass = {t: math.exp(lat.log_mass(unit, t)) for t in taken} if mass is None else mass
    base, first, size, edge_log = lat.steps(unit)
    while first[node] < first[node + 1]:
        edges, free = range(first[node], first[node + 1]), []
        for e in edges:
            same = [t for t in mass if t[: len(path) + 1] == (*path, base + e)]
            whole = math.exp(log_prob + edge_log[e])
            left = whole - sum(mass[t] for t in same)
            # what rounding leaves of a fully taken edge is no mass
            free.append(left if left > 0 and not (same and left < 1e-9 * whole) else 0.0)
        if sum(free) <= 0:
            return None
        pick = rng.random() * sum(free)
        for candidate, f in zip(edges, free, strict=True):
            if f > 0:
                e = candidate
                pick -= f
                if pick < 0:
                    break
        path, log_prob, node = (*path, base + e), log_prob + edge_log[e], node + size[e]
    return path


@dataclass
class Sample:
    value: float
    tokens: np.ndarray
    token_start: np.ndarray
    log_prob: np.ndarray
    frontier: np.ndarray
    taken: dict[int, dict[tuple[int, ...], float]] = field(default_factory=dict)  # of a unit: segmentations and their probabilities


def _rest_values(log_prob: np.ndarray, since: int, cap: float, spent: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The perturbed value of "agrees before unit i, departs in unit i", for units from ``since`` on, of which ``spent``
    holds the logarithms of exponential draws and ``rest`` those of the probabilities to depart."""
    out = np.full(len(log_prob), -np.inf)
    own = log_prob[since:]
    prefix = np.cumsum(log_prob)[since:] - own
    out[since:] = -np.logaddexp(-cap, spent - (prefix + rest))
    return out


def _rest_of(log_prob: np.ndarray) -> np.ndarray:
    """Log of the probability that a unit departs from its segmentation."""
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(log_prob, 0.0)))
    rest[log_prob > -1e-12] = -np.inf  # a unit with one segmentation
    return rest


def sample_texts(vocab: Vocabulary, texts: list[str | None], keys: list[object], k: int, seed: int, lat: Lattices, units: list[np.ndarray]) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text its samples: perturbed value, log-probability, inclusion score, tokens."""
    n = len(texts)
    seeds = np.array([row_seed(seed, key) for key in keys], np.uint64)
    sizes = np.array([len(u) for u in units])
    offset = np.r_[0, np.cumsum(sizes)]
    place = (np.arange(offset[-1]) - np.repeat(offset[:-1], sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        base = mix64(np.repeat(seeds, sizes) + place * np.uint64(0xD1342543DE82EF95))
        roots = -np.log(-np.log(_uniform(seeds + np.uint64(77))))
    every = np.concatenate(units) if n else np.empty(0, np.int64)
    done: list[list[Sample]] = [[] for _ in range(n)]
    pending = {d: (None, 0, float(roots[d])) for d in range(n) if sizes[d]}
    for turn in range(k):
        if not pending:
            break
        since = np.full(n, np.iinfo(np.int64).max)
        for d, (parent, i, _) in pending.items():
            since[d] = 0 if parent is None else i + 1
        with np.errstate(over="ignore"):
            salt = mix64(base + np.uint64(turn + 1) * np.uint64(0xA24BAED4963EE407))
        rows = np.flatnonzero(place.astype(np.int64) >= np.repeat(since, sizes))
        w = walk(lat, every[rows], salt[rows])
        exponential = -np.log(_uniform(salt + np.uint64(5)))
        row_at = np.searchsorted(rows, offset)
        after: dict[int, tuple[Sample | None, int, float]] = {}
        rest, spent = _rest_of(w.log_prob), np.log(exponential)
        for d, (parent, i, value) in pending.items():
            a, b = int(row_at[d]), int(row_at[d + 1])
            tail, tail_start, tail_log = w.tokens[w.token_start[a] : w.token_start[b]], w.token_start[a : b + 1] - w.token_start[a], w.log_prob[a:b]
            if parent is None:
                s = Sample(value, tail, tail_start, tail_log, -np.logaddexp(-value, spent[a:b] - (np.cumsum(tail_log) - tail_log + rest[a:b])))
            else:
                rng = Random(int(seeds[d]) + turn)
                u = int(units[d][i])
                if i not in parent.taken:
                    own_path = path_of(lat, u, parent.tokens[parent.token_start[i] : parent.token_start[i + 1]])
                    parent.taken[i] = {own_path: math.exp(lat.log_mass(u, own_path))}
                taken = parent.taken[i]
                other = draw_other(lat, u, list(taken), rng, taken)
                if other is None:
                    parent.frontier[i] = -np.inf
                    after[d] = _next(done[d])
                    continue
                log_other = lat.log_mass(u, other)
                taken[other] = math.exp(log_other)
                middle = [t for e in other for t in lat.tokens(e)]
                cut = int(parent.token_start[i])
                tokens = np.concatenate([parent.tokens[:cut], np.array(middle, np.int32), tail])
                starts = np.concatenate([parent.token_start[: i + 1], cut + len(middle) + tail_start])
                logs = np.concatenate([parent.log_prob[:i], [log_other], tail_log])
                s = Sample(value, tokens, starts, logs, _rest_values(logs, i + 1, value, spent[offset[d] + i + 1 : offset[d + 1]], rest[a:b]))
                # what is left of the set that was split: neither the parent's segmentation of the unit nor this one
                left = 1.0 - sum(taken.values())
                remains = np.log(left) if left > 1e-9 else -np.inf
                parent.frontier[i] = -np.logaddexp(-value, np.log(rng.expovariate(1.0)) - (parent.log_prob[:i].sum() + remains))
            done[d].append(s)
            after[d] = _next(done[d])
        pending = {d: x for d, x in after.items() if x[2] > -np.inf}
    out = []
    for samples in done:
        kappa = max((float(s.frontier.max(initial=-np.inf)) for s in samples), default=-np.inf)
        rows_out = []
        for s in samples:
            lp = float(s.log_prob.sum())
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(700.0, lp - kappa))))
            rows_out.append((s.value, lp, inclusion, s.tokens))
        out.append(rows_out)
    return out


def _next(samples: list[Sample]) -> tuple[Sample | None, int, float]:
    """The frontier's best set: whose sample it departs from, in which unit, and its value."""
    best: tuple[Sample | None, int, float] = (None, -1, -np.inf)
    for s in samples:
        if len(s.frontier):
            i = int(s.frontier.argmax())
            if s.frontier[i] > best[2]:
                best = (s, i, float(s.frontier[i]))
    return best


def unit_numbers(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct units of texts, and each text's units by number.

    Texts are split and their units numbered by Arrow, but for those where a split at each space does not give the units.
    """
    slow = [i for i, t in enumerate(texts) if not t or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t]
    plain = list(texts)
    for i in slow:
        plain[i] = None
    lists = pc.split_pattern(pa.array(plain, pa.string()), " ")
    found = lists.flatten().dictionary_encode()
    units, sizes = found.dictionary.to_numpy(zero_copy_only=False).tolist(), lists.value_lengths().fill_null(0).to_numpy()
    rows = np.split(found.indices.to_numpy(), np.cumsum(sizes)[:-1]) if texts else []
    if slow:
        number: defaultdict[str, int] = defaultdict(None, zip(units, range(len(units)), strict=True))
        number.default_factory = number.__len__  # a new unit gets the next number
        for i in slow:
            rows[i] = np.array([number[u] for u in units_of(texts[i])], np.int32)
        units = list(number)
    return units, rows


def encode_texts(vocab: Vocabulary, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
    """The library's tokens of each text; also the distinct units (the remembered ones first) and each text's units by number.

    Distinct units are encoded once, remembered ones not again. ``vocab.sound`` tells whether the tokens of
    all these units decode to them, and so those of the texts, which are units end to end, to the texts.
    """
    found, rows = unit_numbers(texts)
    known = len(vocab.kept)
    place = np.fromiter(map(vocab.kept.get, found, repeat(-1)), np.int64, len(found))
    new = np.flatnonzero(place < 0)
    place[new] = known + np.arange(len(new))
    fresh_units = [found[i] for i in new.tolist()]
    units = [*vocab.kept, *fresh_units]
    cuts = np.cumsum([len(r) for r in rows], dtype=np.int64)
    every = place[np.concatenate(rows)] if rows else np.empty(0, np.int64)
    rows = np.split(every, cuts[:-1]) if rows else []
    sizes, flat = vocab.tokens_of(fresh_units)
    vocab.sound = vocab.kept_sound and vocab.spells(fresh_units, flat)
    sizes, flat = np.concatenate([vocab.kept_sizes, sizes]), np.concatenate([vocab.kept_tokens, flat])
    start = np.cumsum(sizes) - sizes
    take = sizes[every]
    ends = np.cumsum(take)
    tokens = flat[_runs(start[every], take, ends)]
    cut = np.r_[0, ends][cuts] if rows else []
    return [tokens[a:b] for a, b in zip([0, *cut[:-1]] if len(cut) else [], cut, strict=True)], units, rows


def _runs(start: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, end to end; in 32 bits, as runs hold far fewer places."""
    n = int(ends[-1]) if len(ends) else 0
    out = np.repeat((start - (ends - size)).astype(np.int32, copy=False), size)
    out += np.arange(n, dtype=np.int32)
    return out


def _octets(vocab: Vocabulary, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes that tokens stand for, end to end, and where each token's bytes end."""
    size = vocab.octets[tokens]
    ends = np.cumsum(size, dtype=np.int32)
    return vocab.octet_text[_runs(vocab.octet_start[tokens], size, ends)].tobytes(), ends


def decoded_bytes(vocab: Vocabulary, coded: list[np.ndarray]) -> list[bytes]:
    """The UTF-8 bytes that each row of tokens stands for, all rows at once."""
    raw, ends = _octets(vocab, np.concatenate(coded) if coded else np.empty(0, np.int32))
    cut = np.r_[0, ends][np.cumsum([0, *map(len, coded)])]
    # the space that encoding puts first goes
    return [raw[a:b].removeprefix(b" ") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


_SAMPLE = pa.struct([("value", pa.float64()), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("decoded", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def token_columns(coded: list[np.ndarray], ids: bool) -> dict[str, pa.Array]:
    """Token arrays as one Arrow list (nulls, if not asked for), their lengths, and crc32 over 32-bit little-endian ids."""
    sizes = np.fromiter(map(len, coded), np.int32, len(coded))
    rows = [np.ascontiguousarray(c, "<i4") for c in coded]
    if ids:
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
    else:
        listed = pa.nulls(len(coded), pa.list_(pa.int32()))
    return {"ids": listed, "n_tokens": pa.array(sizes), "ids_crc32": pa.array(list(map(zlib.crc32, rows)), pa.int64())}


def same_bytes(raw: list[bytes | None], back: list[bytes | None]) -> pa.Array:
    """Whether each row came back; null where there is nothing to compare with."""
    return pa.array([None if r is None else r == b for r, b in zip(raw, back, strict=True)], pa.bool_())


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", samples: int = 2, alpha: float = 2.0, seed: int = 7, check: bool = True, sample_ids: bool = True, ids: bool = True, rows: int = 1000) -> DataFrame:
    """Add ``ids`` (the library's encoding), ``n_tokens``, ``ids_crc32``, ``decoded`` (it decodes to the text, null
    if not checked) and ``samples``: distinct segmentations, best perturbed value first, each with its own ``decoded``.

    ``ids`` and ``sample_ids`` say whether to return the token arrays beside their lengths and crc32 (over
    32-bit little-endian ids). ``rows`` texts are worked on together: more share more units, and take more
    memory (some 60 MB for each MB of text). ``model`` is the path of a SentencePiece file on every executor.
    """
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("decoded", pa.bool_()), ("samples", pa.list_(_SAMPLE))])
    sql = "struct<ids:array<int>,n_tokens:int,ids_crc32:bigint,decoded:boolean,samples:array<struct<value:double,log_prob:double,inclusion:double,n_tokens:int,ids_crc32:bigint,decoded:boolean,ids:array<int>>>>"

    @F.arrow_udf(sql)
    def pieces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with lent(model, alpha) as vocab:
            for key_column, text_column in chain.from_iterable(slices(b, rows) for b in batches):
                all_keys, all_texts = key_column.to_pylist(), text_column.to_pylist()
                if not all_texts:
                    yield pa.array([], kind)
                for a, b in _chunks(all_texts):
                    texts, keys = all_texts[a:b], all_keys[a:b]
                    coded, units, spelt = encode_texts(vocab, texts)
                    raw = [None if t is None else t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for t in texts] if check else [None] * len(texts)
                    back = raw if not check or vocab.sound else decoded_bytes(vocab, coded)
                    drawn = sample_texts(vocab, texts, keys, samples, seed, vocab.lattices_of(units), spelt) if samples and units else [[] for _ in texts]
                    if spelt and len(vocab.kept) < KEPT:
                        vocab.keep(units, np.bincount(np.concatenate(spelt), minlength=len(units)))
                    flat = [x for s in drawn for x in s]
                    flat_raw = [r for r, s in zip(raw, drawn, strict=True) for _ in s]
                    flat_back = decoded_bytes(vocab, [x[3] for x in flat]) if check else flat_raw
                    columns = {
                        "value": pa.array([x[0] for x in flat], pa.float64()), "log_prob": pa.array([x[1] for x in flat], pa.float64()), "inclusion": pa.array([x[2] for x in flat], pa.float64()),
                        **token_columns([x[3] for x in flat], sample_ids), "decoded": same_bytes(flat_raw, flat_back),
                    }
                    ends = np.cumsum([0, *map(len, drawn)])
                    struct = pa.StructArray.from_arrays([columns[f.name] for f in _SAMPLE], fields=list(_SAMPLE))
                    found = token_columns(coded, ids) | {"decoded": same_bytes(raw, back), "samples": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)}
                    yield pa.StructArray.from_arrays([found[f.name] for f in kind], fields=list(kind))
        release_memory()

    name = fresh(docs, "pieces")
    found = docs.withColumn(name, pieces.asNondeterministic()(F.col(key), F.col(text)))
    return found.withColumns({c: F.col(f"{name}.{c}") for c in ("ids", "n_tokens", "ids_crc32", "decoded", "samples")}).drop(name)


def decode(tokens: DataFrame, model: str, *, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``: the text that the token ids in ``ids`` stand for (null for null)."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(model, 2.0)
        for batch in chain.from_iterable(slices(b, 800) for b in batches):
            rows = batch.to_pylist()
            done = iter(vocab.sp.decode([r for r in rows if r is not None]))
            yield pa.array([None if r is None else next(done) for r in rows], pa.string())

    return tokens.withColumn(out, texts(F.col(ids)))
