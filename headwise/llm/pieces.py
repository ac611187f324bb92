"""SentencePiece encoding by sampling without replacement, and decoding.

A text is normalised as its model does it: a space in front, each space as U+2581. Its lattice holds
every vocabulary piece at every place where it matches; a code point without a piece of its own is
one edge of byte pieces. A piece's log-weight is ``-sharpness * log(1 - score)``: the model's scores
are merge ranks, so this is a power law of the rank. Pieces cross neither a line break nor the
boundary in front of a run of U+2581, so the lattice is a chain of short ones, one for each unit
between such places, and equal units share theirs.

The distinct segmentations of a text with the largest perturbed log-probabilities (log-probability
plus Gumbel noise) are a sample without replacement. They are found best first: a node of the
search is the set of segmentations that share a prefix and leave out some next pieces; the log of
its exact probability, from backward sums over the lattice, locates the Gumbel variable of its
maximum, cut off at its parent's. The node with the greatest maximum is taken from the frontier, its
best segmentation is drawn by a walk through the lattice, and what is left splits into one node
for each step of the walk. Noise comes from a hash of the row's key, the round and the place, so a
row gives the same samples in any partition. A sample's inclusion score is its probability of being
among the first k given the (k + 1)th maximum.

Null and empty texts have one segmentation, the empty one; a text with fewer than k segmentations
gives all it has, each with score 1. A null key is a key. Rows that repeat give repeated rows. A
literal U+2581 decodes to a space, as with the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .hashing import U, mix

SPACE = "▁"
#: Lattice edges that a worker keeps for units it has met; then it starts anew.
KEEP_EDGES = 3_000_000
SCATTER = 0x9E3779B97F4A7C15


def uniform(seed: np.ndarray, k: int, at: np.ndarray | int = 0) -> np.ndarray:
    """Numbers in (0, 1) from a hash of (seed, k, at)."""
    x = mix(seed + U((0x9E3779B97F4A7C15 * (k + 1)) % 2**64) ^ mix(np.atleast_1d(at).astype(U) + U(0x632BE59BD9B4E019)))
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Vocabulary:
    """Pieces of a model file, as a trie."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.weight = -sharpness * np.log1p(-np.array([model.get_score(i) for i in range(n)]))
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        trie: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(name[1:-1], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = name.replace(SPACE, " ").encode()
                at = 0
                for c in map(ord, name):
                    if c not in trie[at]:
                        trie[at][c] = len(trie)
                        trie.append({})
                        piece.append(-1)
                    at = trie[at][c]
                piece[at] = i
        # An open-addressed table from (node, code point) to node.
        bits = (4 * len(trie)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.keys = np.full(self.mask + 1, -1)
        self.to = np.full(self.mask + 1, -1)
        for at, m in enumerate(trie):
            for c, to in m.items():
                key = (at << 21) | c
                slot = (key * SCATTER) % 2**64 >> self.shift
                while self.keys[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.to[slot] = key, to
        self.piece = np.array(piece)
        self.byte_weight = float(self.weight[self.byte_id].mean())
        # First moves by table: most code points of a text are small.
        self.first = np.full(1 << 16, -1)
        for c, to in trie[0].items():
            if c < len(self.first):
                self.first[c] = to

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = (state << 21) | code
        slot = ((key.astype(U) * U(SCATTER)) >> U(self.shift)).astype(np.int64)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held[open_] = self.keys[slot[open_]]
            open_ = open_[(held[open_] != key[open_]) & (held[open_] >= 0)]
        return np.where(held == key, self.to[slot], -1)


def grown(x: np.ndarray, used: int, size: int) -> np.ndarray:
    """Room for ``size`` elements with the first ``used`` of ``x``; the rest is not touched and takes no memory yet."""
    out = np.empty(size, dtype=x.dtype)
    out[:used] = x[:used]
    return out


class Lattices:
    """Units met so far: each node's edges, their probability given the node, and where they lead.

    A negative ``piece`` is a code point, -1 - it, without a piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        # Space is taken once and filled as units come.
        self.first = np.zeros(1, dtype=np.int64)
        self.to, self.piece, self.source = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.p = np.zeros(0)
        self._room(KEEP_EDGES, KEEP_EDGES)

    def _room(self, nodes: int, edges: int) -> None:
        if len(self.first) <= nodes:
            self.first = grown(self.first, self.n_nodes + 1, nodes + nodes // 2 + 1)
        if len(self.p) < edges:
            self.to, self.piece, self.source, self.p = (grown(x, self.n_edges, edges + edges // 2) for x in (self.to, self.piece, self.source, self.p))

    def of(self, units: list[str]) -> np.ndarray:
        """First node of each unit."""
        if self.n_edges > KEEP_EDGES:
            self.clear()
        got = list(map(self.start.get, units))
        if None in got:
            lack = [i for i, at in enumerate(got) if at is None]
            self._add(list({units[i] for i in lack}))
            for i in lack:
                got[i] = self.start[units[i]]
        return np.array(got, dtype=np.int64)

    def _add(self, units: list[str]) -> None:
        v = self.vocabulary
        code = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        end = np.repeat(np.cumsum(size), size)
        # A unit of n code points has n + 1 nodes.
        node = np.arange(len(code)) + np.repeat(np.arange(len(units)), size)
        n_nodes = len(code) + len(units)
        at = np.arange(len(code))
        state = np.where(code < len(v.first), v.first[np.minimum(code, len(v.first) - 1)], v.step(np.zeros(len(code), dtype=np.int64), code))
        single = np.zeros(len(code), dtype=bool)
        sources, lengths, pieces = [], [], []
        length = 1
        alive = state >= 0
        at, state = at[alive], state[alive]
        while len(at):
            found = v.piece[state]
            hit = found >= 0
            sources.append(at[hit])
            pieces.append(found[hit])
            lengths.append(np.full(len(sources[-1]), length))
            if length == 1:
                single[at[hit]] = True
            more = at + length < end[at]
            at, state = at[more], state[more]
            state = v.step(state, code[at + length])
            alive = state >= 0
            at, state = at[alive], state[alive]
            length += 1
        lack = np.flatnonzero(~single)
        sources.append(lack)
        pieces.append(-1 - code[lack])
        lengths.append(np.ones(len(lack), dtype=np.int64))
        # Edges by node: those of one length meet each node once at most.
        count = np.zeros(n_nodes, dtype=np.int64)
        for part in sources:
            count[node[part]] += 1
        first = np.concatenate(([0], np.cumsum(count)))
        free = first[:-1].copy()
        source = np.empty(int(first[-1]), dtype=np.int64)
        piece, size_of = np.empty_like(source), np.empty_like(source)
        for part, found, length in zip(sources, pieces, lengths):
            spot = free[node[part]]
            source[spot], piece[spot], size_of[spot] = part, found, length
            free[node[part]] += 1
        weight = v.weight[np.maximum(piece, 0)]
        if len(lack):
            other = piece < 0
            point = -1 - piece[other]
            weight[other] = v.byte_weight * (1 + (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF))
        of_node = node[source]
        to = of_node + size_of
        # Backward sums, all nodes at one distance from their unit's end at a time.
        mass = np.zeros(n_nodes)
        distance = end - np.arange(len(code))
        by = np.argsort(distance, kind="stable")
        cut = np.searchsorted(distance[by], np.arange(1, int(distance.max()) + 2))
        for a, b in zip(cut[:-1], cut[1:]):
            here = node[by[a:b]]
            edges = ragged(first[here], count[here])
            lead = np.cumsum(count[here]) - count[here]
            value = weight[edges] + mass[to[edges]]
            top = np.maximum.reduceat(value, lead)
            mass[here] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[here])), lead))
        p = np.exp(weight + mass[to] - mass[of_node])
        # The likeliest edge of a node comes first: most walks look no further.
        lead = first[:-1][count > 0]
        peak = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, lead), count[count > 0]))
        peak = peak[np.concatenate(([True], of_node[peak[1:]] != of_node[peak[:-1]]))]
        for x in (p, piece, to):
            x[lead], x[peak] = x[peak], x[lead]
        base, edge = self.n_nodes, self.n_edges
        self._room(base + n_nodes, edge + len(p))
        new = slice(edge, edge + len(p))
        self.p[new], self.piece[new], self.to[new], self.source[new] = p, piece, to + base, of_node + base
        self.first[base + 1 : base + 1 + n_nodes] = first[1:] + edge
        self.n_nodes, self.n_edges = base + n_nodes, edge + len(p)
        begins = np.cumsum(size) - size + np.arange(len(units)) + base
        # Set order varies between runs, but not what a unit's nodes hold.
        self.start.update(zip(units, begins.tolist()))

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node at share ``u`` of its probability."""
        edge = self.first[node]
        stop = self.first[node + 1] - 1
        rest = u - self.p[edge]
        open_ = np.flatnonzero((rest >= 0) & (edge < stop))
        while len(open_):
            edge[open_] += 1
            rest[open_] -= self.p[edge[open_]]
            open_ = open_[(rest[open_] >= 0) & (edge[open_] < stop[open_])]
        return edge

    def walk(self, node: np.ndarray, seed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its unit's end, and how many."""
        count = np.zeros(len(node), dtype=np.int64)
        live = np.flatnonzero(self.first[node] < self.first[node + 1])
        at = node[live]
        found = []
        step = 0
        while len(live):
            edge = self.pick(at, uniform(seed[live], k, step))
            found.append((live, edge))
            count[live] += 1
            at = self.to[edge].astype(np.int64)
            on = self.first[at] < self.first[at + 1]
            live, at = live[on], at[on]
            step += 1
        out = np.zeros(int(count.sum()), dtype=np.int64)
        begin = np.cumsum(count) - count
        for step, (who, edge) in enumerate(found):
            out[begin[who] + step] = edge
        return out, count


#: Parts of one in sums of log-probabilities and shares: 1.5e-11 each, room for millions of edges.
FINE = float(1 << 36)


def gumbel_below(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``place`` (a log-probability) given that they are under ``bound``."""
    with np.errstate(over="ignore", divide="ignore"):
        return place - np.log(np.exp(place - bound) - np.log(u))


def sampled(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: (ids, log-probability, perturbed, inclusion), best first."""
    units: list[str] = []
    n_units = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            own = split(text)
            n_units[i] = len(own)
            units += own
    start = lattices.of(units)
    unit0 = np.cumsum(n_units) - n_units
    seed = mix(np.repeat(seeds, n_units) ^ mix(np.arange(len(units)).astype(U) - np.repeat(unit0, n_units).astype(U)))
    doc_of_unit = np.repeat(np.arange(len(texts)), n_units)

    class Path:
        """One emitted path of each of some texts, and the frontier nodes that it left."""

    def make(docs, edges, steps, unit_of, bound, from_, parts, round_):
        """docs: texts of the paths; from_: step at which each began anew; parts: mass left there."""
        path = Path()
        path.docs, path.edges, path.steps, path.unit = docs, edges, steps, unit_of
        path.begin = np.cumsum(steps) - steps
        owner = np.repeat(np.arange(len(docs)), steps)
        logs = np.log(lattices.p[edges])
        # Whole numbers, so that a path's sums do not depend on the paths before it.
        units = np.rint(logs * FINE).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(units)))
        before = (total[:-1] - total[path.begin][owner]) / FINE
        path.logp = (total[path.begin + steps] - total[path.begin]) / FINE
        left = 1.0 - lattices.p[edges]
        if from_ is not None:
            left[path.begin + from_] = parts
        node = lattices.source[edges]
        some = (left > 0) & (lattices.first[node] + 1 < lattices.first[node + 1])
        offset = np.arange(len(edges)) - path.begin[owner]
        if from_ is not None:
            some &= offset >= from_[owner]
        # Only steps with another way left are nodes of the frontier.
        at = np.flatnonzero(some)
        own = owner[at]
        path.open = np.full(len(edges), -np.inf)
        path.open[at] = gumbel_below(before[at] + np.log(left[at]), bound[own], uniform(seeds[docs][own], 1000 + round_, offset[at]))
        path.ids, path.cuts = ids_of(lattices, edges, path.begin)
        return path

    everyone = np.arange(len(texts))
    edges, count = lattices.walk(start, seed, 0)
    steps = np.bincount(doc_of_unit, weights=count, minlength=len(texts)).astype(np.int64) if len(units) else np.zeros(len(texts), dtype=np.int64)
    top = -np.log(-np.log(uniform(seeds, 500)))
    first = make(everyone, edges, steps, np.repeat(np.arange(len(units)), count), top, None, None, 0)
    paths = [first]
    #: For each path and text, the edges ruled out where the path began anew.
    ruled: list[np.ndarray | None] = [None]
    found: list[list] = [[(first.ids[a:b], lp, g)] for a, b, lp, g in zip(first.cuts[:-1], first.cuts[1:], first.logp.tolist(), top.tolist())]
    bound = np.full(len(texts), -np.inf)
    for round_ in range(1, k + 1):
        best = np.full(len(texts), -np.inf)
        which = np.full(len(texts), -1)
        where = np.zeros(len(texts), dtype=np.int64)
        for n, path in enumerate(paths):
            has = np.flatnonzero(path.steps > 0)
            if not len(has):
                continue
            peak = np.maximum.reduceat(path.open, path.begin[has])
            owner = np.repeat(np.arange(len(has)), path.steps[has])
            at = np.flatnonzero(path.open == peak[owner])
            _, one = np.unique(owner[at], return_index=True)
            step = at[one] - path.begin[has]
            docs = path.docs[has]
            better = peak > best[docs]
            best[docs[better]], which[docs[better]], where[docs[better]] = peak[better], n, step[better]
        if round_ == k:
            bound = best
            break
        for n in range(len(paths)):
            docs = np.flatnonzero(which == n)
            if not len(docs):
                continue
            path = paths[n]
            row = np.searchsorted(path.docs, docs)
            step = where[docs]
            spot = path.begin[row] + step
            old = path.edges[spot]
            node = lattices.source[old].astype(np.int64)
            if ruled[n] is not None:
                out = np.where((step == path.from_[row])[:, None], ruled[n][row], -1)
            else:
                out = np.full((len(docs), 1), -1)
            out = np.concatenate((out, old[:, None]), axis=1)
            # Draw among the node's other edges.
            size = lattices.first[node + 1] - lattices.first[node]
            every = ragged(lattices.first[node], size)
            owner = np.repeat(np.arange(len(docs)), size)
            p = lattices.p[every] * ~(every[:, None] == out[owner]).any(axis=1)
            lead = np.cumsum(size) - size
            mass = np.add.reduceat(p, lead)
            # Shares of the node's mass as whole numbers, again apart from what stands before them.
            share = np.rint(p / mass[owner] * FINE).astype(np.int64)
            run = np.concatenate(([0], np.cumsum(share)))
            low, high = run[lead], run[lead + size]
            goal = np.minimum(((high - low) * uniform(seeds[docs], 2000 + round_)).astype(np.int64), high - low - 1)
            ok = (run[1:] - low[owner] > goal[owner]) & (share > 0)
            at = np.flatnonzero(ok)
            _, one = np.unique(owner[at], return_index=True)
            new = every[at[one]]
            left = mass - lattices.p[new]
            left[left < 1e-12 * mass] = 0.0
            # The rest of the unit, then all units after it.
            unit = path.unit[spot]
            after = unit0[docs] + n_units[docs] - 1 - unit
            later = ragged(unit, after + 1)
            nodes = start[later]
            head = np.cumsum(after + 1) - after - 1
            nodes[head] = lattices.to[new]
            tail, many = lattices.walk(nodes, seed[later], round_)
            n_tail = np.add.reduceat(many, head)
            steps = step + 1 + n_tail
            begin = np.cumsum(steps) - steps
            edges = np.empty(int(steps.sum()), dtype=np.int64)
            unit_of = np.empty(len(edges), dtype=np.int64)
            put, take = ragged(begin, step), ragged(path.begin[row], step)
            edges[put], unit_of[put] = path.edges[take], path.unit[take]
            edges[begin + step], unit_of[begin + step] = new, unit
            put = ragged(begin + step + 1, n_tail)
            edges[put], unit_of[put] = tail, np.repeat(later, many)
            path.open[spot] = -np.inf
            fresh = make(docs, edges, steps, unit_of, best[docs], step, left, round_)
            fresh.from_ = step
            paths.append(fresh)
            ruled.append(np.concatenate((out, new[:, None]), axis=1))
            for d, a, b, lp, g in zip(docs.tolist(), fresh.cuts[:-1], fresh.cuts[1:], fresh.logp.tolist(), best[docs].tolist()):
                found[d].append((fresh.ids[a:b], lp, g))
    done = []
    for rows, kappa in zip(found, bound):
        done.append([(e, lp, g, 1.0 if np.isneginf(kappa) else float(-np.expm1(-np.exp(lp - kappa)))) for e, lp, g in rows])
    return done


def split(text: str) -> list[str]:
    """Units of the normalised text."""
    return re.findall(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+", SPACE + text.replace(" ", SPACE))


def ids_of(lattices: Lattices, edges: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths one after another, and where each path's begin (and the last's end).

    A code point without a piece gives the ids of its UTF-8 bytes."""
    ids = lattices.piece[edges]
    cuts = np.append(begin, len(edges))
    other = np.flatnonzero(ids < 0)
    if len(other):
        spelt = [lattices.vocabulary.byte_id[list(chr(-1 - c).encode())] for c in ids[other].tolist()]
        size = np.ones(len(ids), dtype=np.int64)
        size[other] = [len(x) for x in spelt]
        wide = np.repeat(ids, size)
        place = np.concatenate(([0], np.cumsum(size)))
        wide[ragged(place[other], size[other])] = np.concatenate(spelt)
        ids, cuts = wide, place[cuts]
    return ids.astype(np.uint32), cuts


def decoded(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Text of piece ids: their bytes, without the space put in front."""
    return b"".join(map(vocabulary.bytes.__getitem__, ids))[1:].decode()


_held: dict = {}


def _lattices(path: str, sharpness: float) -> Lattices:
    """One for each worker process and model."""
    if (path, sharpness) not in _held:
        _held[path, sharpness] = Lattices(Vocabulary(path, sharpness))
    return _held[path, sharpness]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, sharpness: float = 1.0, seed: int = 2, with_ids: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (id_col, rank, n_tokens, ids_crc32, log_prob, perturbed, inclusion, round_trip [, ids] [, carried columns]).

    ``rank`` counts a text's samples from 1; ids_crc32 is that of the ids as little-endian 32-bit
    integers; round_trip tells that the ids decode to the text. Columns named in ``carry`` are passed through. ``model`` is a path on the workers.
    """
    names = [id_col, "rank", "n_tokens", "ids_crc32", "log_prob", "perturbed", "inclusion", "round_trip", *["ids"] * with_ids, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(model, sharpness)
        vocabulary = lattices.vocabulary
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            seeds = mix(np.asarray(batch.column("key")).view(U) + U(seed))
            rows, whole, take = [], [], []
            for i, samples in enumerate(sampled(lattices, texts, seeds, k)):
                plain = (texts[i] or "").replace(SPACE, " ").encode()
                for rank, (ids, lp, g, share) in enumerate(samples, 1):
                    trip = b"".join(map(vocabulary.bytes.__getitem__, ids.tolist()))[1:] == plain
                    take.append(i)
                    rows.append((rank, len(ids), zlib.crc32(ids), lp, g, share, trip))
                    if with_ids:
                        whole.append(ids.view(np.int32))
            out = [batch.column("id").take(pa.array(take)), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())))]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(w) for w in whole]))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole))))
            out += [c.take(pa.array(take)) for c in batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, rank int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean" + ", ids array<int>" * with_ids
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("key"), *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)))
    return texts.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", sharpness: float = 1.0) -> DataFrame:
    """``rows`` with the text of their ids in place of ``ids_col``; null ids give null."""
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _lattices(model, sharpness).vocabulary
        for batch in batches:
            texts = [None if ids is None else decoded(vocabulary, ids) for ids in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [f"`{f.name}` {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)]
    return rows.mapInArrow(run, ", ".join(fields))
