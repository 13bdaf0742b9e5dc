"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

Gumbel top-k by a perturbed A-star search: a region of segmentations has the largest of its perturbed log
probabilities, a Gumbel variable about the log of its mass, cut off by the value of the region that holds it. The
search takes the region of the largest value, draws the segmentation that has it, and splits what is left.
A region is "shares the pieces of a path before some place from lo to hi and differs there", less some pieces at
lo; its mass telescopes along the path, so a whole lattice is never expanded.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import mix64, slices

SPACE = "▁"
_PARTS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
_FILTER_BITS = 18


#: Texts that a model without normaliser, and with a space before each text, gives back as they are.
_PROBES = ("a", " a", "a ", "a  b", "\ufb01\uff21\u2460", "e\u0301", "\u00a0\t", "a\nb")


def _check_model(model, path: str) -> None:
    """Sampling rests on two things: no piece crosses the parts of a text, and texts are not normalised."""
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"{path}: the piece {piece!r} crosses the parts of a text; such models can't be sampled")
    changed = [t for t in _PROBES if model.decode(model.encode(t)) != t]
    if changed:
        raise ValueError(f"{path}: the model normalises texts ({changed[0]!r}); such models can't be sampled")


class Pieces:
    """The vocabulary of a SentencePiece model as a distribution over pieces.

    A BPE model scores a piece by minus its rank: it gets the weight 1 / (rank + 2). Scores that are not such ranks are
    log probabilities already. A character without a piece is the bytes of its UTF-8 form, at a fixed low weight.
    """

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _check_model(sp, path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in plain])
        ranks = len(plain) > 1 and bool((score <= 0).all() and (score == np.rint(score)).all())
        weight = -np.log(np.minimum(-score, n) + 2) if ranks else score
        weight = (weight - np.logaddexp.reduce(weight)) / temperature
        self.byte_weight = float(weight.min()) - 4 / temperature
        self.bytes_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.size, names = n, [sp.id_to_piece(i) for i in plain]
        self.text = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        for i, name in zip(plain, names, strict=True):
            self.text[i] = name.encode()
        self.longest = max(map(len, names))
        #: For each length the hashes of its pieces in order, their ids and weights, and by slot whether a piece is (1) or a longer one begins (2) there.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        code, length = _codes("".join(names)), np.array([len(name) for name in names])
        begin, own = np.cumsum(length) - length, np.array(plain)
        h, at = np.zeros(len(names), np.uint64), np.arange(len(names))
        for size in range(1, self.longest + 1):
            h = h * _P + code[begin[at] + (size - 1)] + np.uint64(1)
            ends = length[at] == size
            marks = np.zeros(1 << _FILTER_BITS, np.uint8)
            marks[_slot(h[ends])] = 1
            marks[_slot(h[~ends])] |= 2
            order = np.flatnonzero(ends)[np.argsort(h[ends])]
            self.by_length[size] = (h[order], own[at[order]], weight[at[order]], marks)
            h, at = h[~ends], at[~ends]
        self.piece_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.piece_size = np.array([len(t) for t in self.text])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size

    def spelled(self, char: str) -> list[int]:
        found = [self.bytes_ids.get(f"<0x{b:02X}>") for b in char.encode()]
        return [self.unknown] if None in found else found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for: spaces for their mark, without the one before the text."""
        size = self.piece_size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        at = np.repeat(self.piece_start[ids] - (ends - size), size) + np.arange(ends[-1])
        whole = self.piece_bytes[at].tobytes().replace(SPACE.encode(), b" ")
        return whole[1:] if whole[:1] == b" " else whole


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * _P >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Lattice:
    """The lattices of a batch's distinct parts: a state for each character, edges by state, the likeliest first."""

    def __init__(self, pieces: Pieces, parts: pa.Array):
        _, ends, data = parts.buffers()
        ends = np.frombuffer(ends, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        code = _codes(data[int(ends[0]) : int(ends[-1])].to_pybytes().decode())
        length = pc.utf8_length(parts).to_numpy().astype(np.int64)
        self.start = np.cumsum(length) - length
        n = len(code)
        left = np.repeat(self.start + length, length) - np.arange(n)
        h, at = np.zeros(n, np.uint64), np.arange(n)
        covered = np.zeros(n, bool)
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, (table, own, w, marks) in pieces.by_length.items():
            h = h * _P + code[at + (size - 1)] + np.uint64(1)
            mark = marks[_slot(h)]
            maybe = np.flatnonzero(mark & 1)
            place = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
            hit = table[place] == h[maybe]
            maybe, place = at[maybe[hit]], place[hit]
            if size == 1:
                covered[maybe] = True
            found.append((size, maybe, own[place], w[place]))
            more = np.flatnonzero((mark > 1) & (left[at] > size))
            h, at = h[more], at[more]
            if not len(at):
                break
        bare = np.flatnonzero(~covered)
        chars, which = np.unique(code[bare], return_inverse=True)
        self.spelled = [pieces.spelled(chr(int(c))) for c in chars]
        spelled = np.array([len(s) for s in self.spelled], float)[which] * pieces.byte_weight if len(bare) else np.zeros(0)
        found.insert(0, (1, bare, pieces.size + which, spelled))

        degree = np.zeros(n + 1, np.int64)
        for _, src, _, _ in found:
            degree[src] += 1
        self.first = np.cumsum(degree) - degree
        edges = int(self.first[n])
        self.dst, self.ids, self.final = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, bool)
        weight, slot = np.empty(edges), self.first.copy()
        for size, src, ids, w in reversed(found):  # long pieces first: mostly the likelier
            to = slot[src]
            slot[src] = to + 1
            self.dst[to], self.ids[to], self.final[to], weight[to] = src + size, ids, left[src] == size, w
        del found, src, ids, w, to, slot  # the masses take the same room again
        self.logp, self.upto = self._masses(weight, degree[:n], left)
        at = np.arange(n)
        for rank in range(1, int(degree.max())):  # chances of a state's edges add up one after the other
            at = at[degree[at] > rank]
            edge = self.first[at] + rank
            self.upto[edge] += self.upto[edge - 1]
        self.upto[self.first[1:] - 1] = 2.0
        self.ext_size = np.concatenate([np.ones(pieces.size, np.int64), np.array([len(s) for s in self.spelled], np.int64)])
        self.ext_flat = np.concatenate([np.arange(pieces.size), np.array([i for s in self.spelled for i in s], np.int64)])
        self.ext_start = np.cumsum(self.ext_size) - self.ext_size

    def _masses(self, weight: np.ndarray, degree: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each edge the log of its chance and the chance, given its state, from the masses of states, those nearest to an end first."""
        n = len(left)
        states = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        size = degree[states]
        ends = np.cumsum(size)
        order = (np.repeat(self.first[states] - (ends - size), size) + np.arange(len(weight))).astype(np.int32)
        w, to = weight[order], np.where(self.final, n, self.dst)[order]
        logp, chance = np.empty(len(weight)), np.empty(len(weight))
        beta = np.zeros(n + 1)
        cuts = np.cumsum(np.bincount(left)[1:]).tolist() if n else []
        s = a = 0
        for e in cuts:
            if s == e:
                continue
            b, own = int(ends[e - 1]), size[s:e]
            first = ends[s:e] - own - a
            mass = w[a:b] + beta[to[a:b]]
            top = np.maximum.reduceat(mass, first)
            mass -= np.repeat(top, own)
            share = np.exp(mass)
            total = np.add.reduceat(share, first)
            rest = np.log(total)
            beta[states[s:e]] = top + rest
            logp[order[a:b]], chance[order[a:b]] = np.minimum(mass - np.repeat(rest, own), 0.0), share / np.repeat(total, own)
            s, a = e, b
        return logp, chance

    def walk(self, parts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each of parts, drawn with its random key: edges, part after part, and their number."""
        state, active = self.start[parts], np.arange(len(parts))
        steps, count = [], np.zeros(len(parts), np.int64)
        t = 0
        while len(active):
            u = uniform(keys[active] + np.uint64((t + 1) * 0xD1B54A32D192ED03 & _MASK))
            edge = self.first[state]
            more = np.flatnonzero(u > self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > self.upto[edge[more]]]
            steps.append((active, edge))
            count[active] += 1
            go = ~self.final[edge]
            active, state = active[go], self.dst[edge[go]]
            t += 1
        out, begin = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        for t, (who, edge) in enumerate(steps):
            out[begin[who] + t] = edge
        return out, count

    def continued(self, edge: int, key: int) -> list[int]:
        """Edges that follow `edge` to the end of its part."""
        out, t = [], 0
        while not self.final[edge]:
            state, t = self.dst[edge], t + 1
            u = _uniform(key + t * 0xA0761D6478BD642F)
            edge = int(self.first[state])
            while u > self.upto[edge]:
                edge += 1
            out.append(edge)
        return out

    def piece_ids(self, edges: np.ndarray) -> np.ndarray:
        ext = self.ids[edges]
        size = self.ext_size[ext]
        if (size == 1).all():
            return self.ext_flat[self.ext_start[ext]]
        ends = np.cumsum(size)
        return self.ext_flat[np.repeat(self.ext_start[ext] - (ends - size), size) + np.arange(ends[-1])]


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _mix(x: int) -> int:
    x &= _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _uniform(key: int) -> float:
    return ((_mix(key) >> 11) + 0.5) * 2.0**-53


@dataclass
class _Path:
    edges: np.ndarray
    begin: np.ndarray  # the place of the first piece of each part
    logp: np.ndarray = field(init=False)

    def measure(self, lattice: Lattice) -> _Path:
        self.logp = np.concatenate([[0.0], np.cumsum(lattice.logp[self.edges])])
        return self


@dataclass
class Sample:
    ids: np.ndarray
    logp: float
    perturbed: float
    inclusion: float


def _below(location: float, top: float, u: float) -> float:
    """A Gumbel variable about `location`, given that it is at most `top`."""
    gumbel = location - math.log(-math.log(u))
    if top == math.inf:
        return gumbel
    # -log(exp(-top) + exp(-gumbel)), whose distribution is the cut-off one
    a, b = -top, -gumbel
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


def sample_top(lattice: Lattice, fresh: Callable[[int], _Path], key: int, k: int) -> list[Sample]:
    """The k segmentations of largest perturbed log probability, best first; fewer if the text has fewer.

    fresh(s) is the s-th independent draw of the whole text. inclusion is the chance, given the value of the
    segmentation that just fails to be among the k, that a segmentation is among them (1 if none fails).
    """
    draws = iter(range(1, 1 << 30))
    random = lambda: _uniform(key + next(draws) * 0xE7037ED1A0B428DB)
    found: list[tuple[float, _Path]] = []
    heap: list[tuple] = []

    def push(path: _Path, lo: int, hi: int, less: tuple[int, ...], top: float) -> None:
        if lo > hi:
            return
        gone = sum(math.exp(lattice.logp[e]) for e in less)
        mass = -math.expm1(path.logp[hi + 1] - path.logp[lo]) - gone
        if mass > 1e-12:
            location = float(path.logp[lo]) + math.log(mass)
            heapq.heappush(heap, (-_below(location, top, random()), next(draws), path, lo, hi, less, gone, mass))

    path = fresh(0).measure(lattice)
    top = _below(0.0, math.inf, random())
    found.append((top, path))
    push(path, 0, len(path.edges) - 1, (), top)
    while heap and len(found) <= k:
        value, _, path, lo, hi, less, gone, mass = heapq.heappop(heap)
        rest = 1 - gone - random() * mass
        j = lo + int(np.searchsorted(-path.logp[lo + 1 : hi + 2], -(path.logp[lo] + math.log(max(rest, 1e-300))))) if rest > 0 else hi
        j = min(max(j, lo), hi)
        new, barred = None, None
        while new is None:
            edge = int(path.edges[j])
            barred = {edge, *(less if j == lo else ())}
            a = int(lattice.first[_state(lattice, path, j)])
            others = []
            while True:
                if a not in barred:
                    others.append((a, math.exp(lattice.logp[a])))
                if lattice.upto[a] == 2.0:
                    break
                a += 1
            if others:
                u = random() * sum(p for _, p in others)
                for new, p in others:  # noqa: B007
                    u -= p
                    if u <= 0:
                        break
            else:  # rounding led to a place without another piece
                j = j + 1 if j < hi else lo
        part = int(np.searchsorted(path.begin, j, "right")) - 1
        tail = fresh(len(found))
        after = int(tail.begin[part + 1]) if part + 1 < len(tail.begin) else len(tail.edges)
        middle = [new, *lattice.continued(new, key ^ len(found) * 0x8EBC6AF09C88C6E3)]
        edges = np.concatenate([path.edges[:j], np.array(middle, np.int64), tail.edges[after:]])
        begin = np.concatenate([path.begin[: part + 1], tail.begin[part + 1 :] + (j + len(middle) - after)])
        child = _Path(edges, begin).measure(lattice)
        found.append((-value, child))
        push(path, lo, j - 1, less, -value)
        if len(others) > 1:  # the path's own piece is not among those that are less: its mass is off already
            push(path, j, j, tuple((barred | {new}) - {edge}), -value)
        push(path, j + 1, hi, (), -value)
        push(child, j + 1, len(child.edges) - 1, (), -value)
    bar = found[k][0] if len(found) > k else -math.inf
    out = []
    for value, path in found[:k]:
        logp = float(path.logp[-1])
        out.append(Sample(lattice.piece_ids(path.edges), logp, value, 1.0 if bar == -math.inf else -math.expm1(-math.exp(min(logp - bar, 700.0)))))
    return out


def _state(lattice: Lattice, path: _Path, j: int) -> int:
    """The state before the j-th piece of a path."""
    part = int(np.searchsorted(path.begin, j, "right")) - 1
    if path.begin[part] == j:
        return int(np.searchsorted(lattice.first, path.edges[j], "right")) - 1
    return int(lattice.dst[path.edges[j - 1]])


def _marked(text: str | None) -> str:
    """A text's parts, which no piece crosses, with spaces between: each begins at a run of spaces or at a line feed."""
    if not text:
        return ""
    if SPACE in text or "  " in text:
        return " ".join(_PARTS.findall(SPACE + text.replace(" ", SPACE)))
    return SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")


def _parts(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The parts of all texts as places among the distinct ones, these, and the number of parts of each text."""
    split = pc.split_pattern(pa.array([_marked(t) for t in texts], pa.large_string()), " ")
    size, flat = pc.list_value_length(split).to_numpy(zero_copy_only=False), split.flatten()
    held = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(texts)), size)[held.to_numpy(zero_copy_only=False)]
    coded = flat.filter(held).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.bincount(row, minlength=len(texts))


def sampled(pieces: Pieces, texts: list[str | None], keys: list[int], k: int) -> list[list[Sample]]:
    """The k sampled segmentations of each text, seeded by its key. An empty text has one, of no piece."""
    flat, distinct, count = _parts(texts)
    empty = [Sample(np.zeros(0, np.int64), 0.0, 0.0, 1.0)]
    if not len(flat):
        return [list(empty) for _ in texts]
    lattice = Lattice(pieces, distinct)
    begin = np.cumsum(count) - count
    own = np.arange(len(flat)) - np.repeat(begin, count)
    seed = np.repeat(np.array(keys, np.uint64), count)
    draws: list[tuple[np.ndarray, np.ndarray]] = []
    out = []
    for s in range(k + 1):
        key = mix64(seed + own.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64((s + 1) * 0x589965CC75374CC3 & _MASK))
        edges, size = lattice.walk(flat, key)
        draws.append((edges, np.concatenate([[0], np.cumsum(size)])))
    for i, n in enumerate(count.tolist()):
        if not n:
            out.append(list(empty))
            continue
        a, b = int(begin[i]), int(begin[i]) + n

        def fresh(s: int, a: int = a, b: int = b) -> _Path:
            edges, at = draws[s]
            return _Path(edges[at[a] : at[b]], at[a:b] - at[a])

        out.append(sample_top(lattice, fresh, _mix(keys[i] ^ 0x1D8E4E27C47D124F), k))
    return out


#: Bytes of text whose lattices and draws are held at once.
_SLICE = 2 << 20


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))


@lru_cache(2)
def _pieces(path: str, temperature: float) -> Pieces:
    """A worker reads a model once, not once for each task."""
    return Pieces(path, temperature)


def _encoder(path: str, k: int, temperature: float, keep_ids: bool, seed: int) -> Callable:
    def encoded(pieces: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        keys = [xxhash.xxh3_64_intdigest(str(i) if i is not None else "text " + (t or ""), seed) for i, t in zip(ids, texts, strict=True)]
        found, round_trip, number = [], [], []
        for text, samples in zip(texts, sampled(pieces, texts, keys, k), strict=True):
            whole = (text or "").encode()
            round_trip.append(all(pieces.decode(s.ids) == whole for s in samples))
            number.append(len(samples))
            found += [Sample(s.ids.astype(np.int32), s.logp, s.perturbed, s.inclusion) for s in samples]
        n, size = np.array(number, np.int64), np.array([len(s.ids) for s in found], np.int64)
        columns = {
            "n_samples": pa.array(n.astype(np.int32)), "n_ids": _lists(size, n), "crc32s": _lists(np.array([_crc(s.ids) for s in found], np.int64), n),
            "logps": _lists(np.array([s.logp for s in found]), n), "perturbed": _lists(np.array([s.perturbed for s in found]), n),
            "inclusion": _lists(np.array([s.inclusion for s in found]), n), "round_trip": pa.array(round_trip, pa.bool_()),
        }
        if keep_ids:
            inner = _lists(np.concatenate([s.ids for s in found]), size)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), inner)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path, temperature)
        for batch in slices(batches, budget=_SLICE):
            yield encoded(pieces, batch)  # lattices and draws are gone by now

    return run


def _crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, temperature: float = 1.0, keep_ids: bool = True, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_samples, n_ids, crc32s, logps, perturbed, inclusion, round_trip, and ids.

    The lists hold k distinct segmentations of the whole text, drawn without replacement, the largest perturbed log
    probability first; fewer where a text has fewer. crc32s are of the ids as little-endian uint32; round_trip
    tells that each decodes to the text (not for texts that hold the mark of a space themselves). Draws depend on
    the seed, doc_id and text alone (the text where doc_id is null), so reruns and repeated rows agree. Null
    and empty texts have one segmentation, of no piece. Other columns are not read; an empty table gives no rows.
    A worker holds the lattices of 2 MB of text, or of one text that is longer. A model with a normaliser, or
    with a piece that crosses the parts of a text, is refused with an error.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_samples int, n_ids array<long>, crc32s array<long>, logps array<double>, perturbed array<double>, inclusion array<double>, round_trip boolean"
    return docs.select("doc_id", F.col("text")).mapInArrow(_encoder(model, k, temperature, keep_ids, seed), schema + ", ids array<array<int>>" * keep_ids)
