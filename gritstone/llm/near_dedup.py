"""Near-duplicate detection with HyperMinHash registers, banding and confirmation on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import free_names, mix64, scratch, slices, stored

MANTISSA = 10
#: Rows of a bucket that are compared with each other in one piece.
PIECE = 128
_A, _B, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words; forgets all once it holds `most`, so memory is bounded."""

    most = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: pa.Array, words: int, cache: dict) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each text, A-Z lower-cased.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    every = np.fromiter(map(cache.__getitem__, distinct), np.uint64, len(distinct))[code]
    count = pc.list_value_length(lists).to_numpy()
    if "" in distinct:  # at the ends of a text
        full = code != distinct.index("")
        row = np.repeat(np.arange(len(count)), count)
        every, count = every[full], np.bincount(row[full], minlength=len(count))
    ends = np.cumsum(count)
    out, wide = [], every[:0]
    if len(every) >= words:
        wide = np.full(len(every) - words + 1, words, np.uint64)
        for i in range(words):
            wide = mix64(wide * _A + every[i : len(every) - words + 1 + i] + _B)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(wide[a : b - words + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                short = mix64(short * _A + every[i : i + 1] + _B)
            out.append(short)
        else:
            out.append(every[:0])
    return out


def hyperminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Registers of 16 bits, len(sets) x m: 6 bits of leading zeros, 10 of mantissa.

    An element's hash names its bucket and its value; a bucket keeps the smallest value. Buckets that no
    element chose are filled by further rounds of hashing (in rounds m to 2m each bucket in turn), so that
    each register of two sets agrees with the probability of their Jaccard similarity, however small they are.
    Rounds after the first take the place of leading zeros that the first cannot have.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    doc, elements = np.repeat(np.arange(n), size), (np.concatenate(sets) if n else np.zeros(0, np.uint64))
    value, filled_in = np.full(n * m, np.iinfo(np.uint64).max, np.uint64), np.full(n * m, 255, np.uint8)
    r = 0
    while len(elements):
        h = mix64(elements + np.uint64((r + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        bucket = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) if r < m else np.full(len(h), r - m)
        at, v = doc * m + bucket, mix64(h ^ _B)
        if r:
            free = filled_in[at] == 255
            at, v = at[free], v[free]
        np.minimum.at(value, at, v)
        filled_in[at] = min(r, 9)
        need = (filled_in.reshape(n, m) == 255).any(axis=1)[doc]
        doc, elements, r = doc[need], elements[need], r + 1
    part, exponent = np.frexp((value >> np.uint64(11)).astype(np.float64))
    zeros = np.where(filled_in == 0, 53 - exponent, 53 + filled_in)
    mantissa = np.clip((part - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa).reshape(n, m)


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    n, m = registers.shape
    count = m // rows
    parts = registers[:, : count * rows].reshape(n, count, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(count, dtype=np.uint64) * _A, (n, count)).copy()
    for i in range(rows):
        key = mix64(key * _B + parts[:, :, i] + _A)
    return key.view(np.int64)


def _loads(size: np.ndarray, m: int) -> np.ndarray:
    """For sets of these sizes, the chances of each number of leading zeros, and last that of a bucket no element chose."""
    zeros, load = 0.5 ** np.arange(54), np.asarray(size, float)[:, None] / m
    return np.concatenate([np.exp(-load * zeros / 2) - np.exp(-load * zeros), np.exp(-load)], axis=1)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of row i of a with row i of b from their registers, less what registers agree by chance.

    Two unrelated minima agree if their leading zeros and their mantissas do; the chance of the former
    follows from the load of a bucket, of the latter it is 2 to the minus 10.
    """
    chance = (_loads(size_a, a.shape[1]) * _loads(size_b, a.shape[1])).sum(1) / (1 << MANTISSA)
    return ((a == b).mean(1) - chance) / (1 - chance)


def estimate_all(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The same for each row of a with each of b."""
    chance = _loads(size_a, a.shape[1]) @ _loads(size_b, a.shape[1]).T / (1 << MANTISSA)
    same = np.stack([(b == row).mean(1) for row in a])
    return (same - chance) / (1 - chance)


def linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (a, b) of sets are linked: common shingles are counted by a product of 0/1 matrices."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = [sets[i] for i in used]
    size = np.array([len(x) for x in own])
    _, code, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), size)
    shared = count > 1
    row, code = row[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((len(own), len(own)), np.float32)
    for start in range(0, int(shared.sum()), 8192):
        i, j = np.searchsorted(code, [start, start + 8192])
        hold = np.zeros((len(own), min(8192, int(shared.sum()) - start)), np.float32)
        hold[row[i:j], code[i:j] - start] = 1
        common += hold @ hold.T
    i, j = place[: len(a)], place[len(a) :]
    both = np.rint(common[i, j]).astype(np.int64)
    return 100 * both >= percent * (size[i] + size[j] - both)


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of those of the pairs that join what the earlier ones do not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            up[max(x, y)] = min(x, y)
            out.append(n)
    return out


def _signer(words: int, m: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words, cache)
            regs = hyperminhash(sets, m)
            keys = bands(regs, rows)
            n = pa.array([len(s) for s in sets], pa.int64())
            whole = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, whole, pa.array([r.tobytes() for r in regs], pa.binary()), lists], ["doc_id", "n", "whole", "regs", "bands"])

    return run


def _setter(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words, cache)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def _estimator(m: int, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = estimate(_matrix(batch.column("regs_a"), m), _matrix(batch.column("regs_b"), m), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _confirmer(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "shingles_a", 16 << 20):
                linked = []
                for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        linked.append(False)
                        continue
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * common >= percent * (len(both) - common))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _partners(m: int, least: float, percent: int | None = None, joining: bool = False) -> Callable:
    """Of the rows of a piece (sorted by piece), pairs of different labels whose estimate is `least` or more.

    side 0 rows are compared with side 1 rows, or with each other in pieces that hold no side 1. Each row gives its
    best pair. If `joining`, the pairs given are those that join what the piece's earlier pairs do not: fewer than
    the piece has rows. With a percent, pairs are confirmed on their whole sets here, and links that
    join what the piece's earlier links do not are given.
    """

    def pairs(group: dict) -> tuple[np.ndarray, np.ndarray]:
        node, label, n, regs = (group[k] for k in ("node", "label", "n", "regs"))
        left = np.flatnonzero(group["side"] == 0)
        right = np.flatnonzero(group["side"] == 1)
        right = right if len(right) else left
        if not len(left):
            return node[:0], node[:0]
        apart = label[left][:, None] != label[right]
        if not apart.any():
            return node[:0], node[:0]
        near = np.where(apart, estimate_all(regs[left], regs[right], n[left], n[right]), -1.0)
        if joining:
            i, j = np.nonzero(near >= least)
            keep = _spanning(node[left[i]], node[right[j]])
            a, b = left[i[keep]], right[j[keep]]
        elif percent is None:
            best = near.argmax(axis=1)
            good = np.flatnonzero(near[np.arange(len(left)), best] >= least)
            a, b = left[good], right[best[good]]
        else:
            i, j = np.nonzero(near >= least)
            a, b = left[i], right[j]
            if len(a):
                true = linked(group["sets"], a, b, percent)
                a, b = a[true], b[true]
                keep = _spanning(label[a], label[b])
                a, b = a[keep], b[keep]
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            piece = table.column("piece").to_numpy()
            cuts = np.flatnonzero(np.diff(piece)) + 1
            ends = [*cuts, *([len(piece)] if last else [])]
            data = {k: table.column(k).to_numpy() for k in ("node", "label", "n", "side")} | {"regs": _matrix(table.column("regs"), m)}
            if percent is not None:
                data["sets"] = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            start = 0
            for end in ends:
                yield {k: v[start:end] for k, v in data.items()}
                start = end
            return table.slice(start)

        def emit(table: pa.Table, last: bool):
            nonlocal held
            found = []
            walk = groups(table, last)
            while True:
                try:
                    found.append(pairs(next(walk)))
                except StopIteration as end:
                    held = end.value
                    break
            a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield emit(pa.concat_tables([held, table]) if held is not None and held.num_rows else table, False)
        if held is not None and held.num_rows:
            yield emit(held, True)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges (a, b) lead to, for each node of an edge.

    Each round merges every node into its least neighbour's least neighbour (itself, if it is the least), and keeps the
    distinct edges between what is left; so a round reads only edges that the rounds before did not settle. The smallest node of a component is
    never merged into another. Each step is a stored table.
    """
    with scratch(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, state = stored(both, "cc-edges"), None
    while True:
        lead = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "cc-lead")
        lead = stored(lead.join(lead.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("label") == F.col("at")).select(F.col("node").alias("at"), F.col("far")), "cc-jump")
        if state is None:
            state = lead.select(F.col("at").alias("node"), F.col("far").alias("label"))
        else:
            state = stored(state.join(lead, F.col("label") == F.col("at"), "left").select("node", F.coalesce("far", "label").alias("label")), "cc-state")
        ends = lead.select(F.col("at").alias("at_b"), F.col("far").alias("far_b"))
        both = both.join(lead, F.col("a") == F.col("at")).join(ends, F.col("b") == F.col("at_b")).select(F.col("far").alias("a"), F.col("far_b").alias("b"))
        both = stored(both.where("a <> b").distinct(), "cc-edges")
        if both.isEmpty():
            return stored(state, "cc-labels", keep=True)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, registers: int = 125, rows: int | None = None, slack: float = 0.16) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of word shingles; component_id
    is the smallest doc_id that links lead to. Equal sets are one class, found by a 128-bit hash of the set,
    and only a class's smallest document is compared. Documents that agree in a band of registers are
    candidates. A candidate pair is dropped where its estimate, corrected for chance, is below percent/100 less
    `slack` (five standard deviations); the rest are confirmed on the whole sets.

    A bucket is never expanded into all its pairs: its members are held against its smallest document; then,
    in buckets that still hold several components, twice against their best partner of another component; and
    last, what is left in buckets of several components is joined exactly, by the rarest shingles of each set, in pieces
    of a bounded number of rows. So each linked pair that shares a bucket is in one component in the end.
    With 5 rows to a band a pair of 85 % is missed by all 25 bands with a chance of 4e-7; below that 4 rows are
    used (31 bands; 8e-8 at 80 %).

    Null and empty texts, and texts without words, have no shingle, are linked with nothing and stay. Rows that
    share a doc_id are linked with each other. A null doc_id is never linked and stays, with a null component_id.
    Other columns are not read. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return _near_duplicates(docs, words, percent, registers, rows, slack)


def _near_duplicates(docs: DataFrame, words: int, percent: int, registers: int, rows: int | None, slack: float) -> DataFrame:
    rows = rows or (5 if percent >= 85 else 4)
    m, least = registers // rows * rows, percent / 100 - slack
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(read.mapInArrow(_signer(words, m, rows), "doc_id long, n long, whole binary, regs binary, bands array<long>"), "near-signed", keep=True)
    classes = signed.where("n > 0 and doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "near-classes")
    heads = signed.join(classes.withColumnRenamed("whole", "w_"), (F.col("whole") == F.col("w_")) & (F.col("doc_id") == F.col("node")))
    heads = stored(heads.dropDuplicates(["node", "whole"]).select("node", "n", "regs", "bands"), "near-heads")
    spread = stored(heads.select("node", F.explode("bands").alias("key")), "near-bands")
    shared = spread.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    members = stored(spread.join(stored(shared, "near-shared"), "key"), "near-members")
    nodes = stored(members.select("node").distinct(), "near-nodes")
    regs = stored(heads.select("node", "n", "regs").join(nodes, "node", "left_semi"), "near-regs")
    texts = read.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    sets = stored(texts.mapInArrow(_setter(words), "node long, shingles binary").where("octet_length(shingles) > 0"), "near-sets")

    def sides(pairs: DataFrame, table: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(table.select(*(F.col(c).alias(f"{c}_{x}") for c in table.columns)), F.col(x) == F.col(f"node_{x}"))
        return pairs

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(sides(pairs, sets).select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmer(percent), "a long, b long").distinct(), "near-links")

    star = stored(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "near-star")
    likely = sides(star, regs).select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(_estimator(m, least), "a long, b long").distinct()
    links = confirmed(stored(likely, "near-likely"))
    tried = star
    labels = components(links)
    held: DataFrame | None = None
    for last in (False, False, True):
        known = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        known = stored(known, "near-known")
        mixed = _mixed(known)
        if mixed.isEmpty():
            break
        rows = known.join(mixed, "key")
        if last:
            # pieces of one table saw all the pairs of their bucket: who has a likely partner there is in `held`
            crowd = rows.where(F.col("majors") + F.col("minors") > PIECE).select("node").unionByName(held).distinct()
            rest = rows.select("node", "label").distinct().join(stored(crowd, "near-crowd"), "node", "left_semi")
            near = _in_crowds(stored(rest, "near-rest"), regs, sets, m, least, percent)
        else:
            pieces = stored(_pieces(rows, False), "near-pieces").join(regs, "node").select("piece", "side", "node", "label", "n", "regs")
            near = stored(_by_piece(pieces).mapInArrow(_partners(m, least), "a long, b long").distinct(), "near-partners")
        held = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
        new = near
        if not last:
            pairs = stored(near.join(tried, ["a", "b"], "left_anti"), "near-pairs")
            new, tried = confirmed(pairs), stored(tried.unionByName(pairs), "near-tried")
        if not new.isEmpty():
            links = stored(links.unionByName(new), "near-links-so-far")
            labels = components(links)
    node = classes.join(labels.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").select("whole", F.coalesce("label", "node").alias("c_"))
    node = stored(node, "near-components", keep=True)
    out = signed.select("doc_id", "n", "whole").join(node, "whole", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("c_", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices([whole], "shingles", 8 << 20):
            size = pc.binary_length(batch.column("shingles")).to_numpy().astype(np.int64) // 8
            pick = lambda c, size=size, batch=batch: pa.array(np.repeat(batch.column(c).to_numpy(), size))
            every = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pick("node"), pick("label"), pa.array(every), pa.array(np.repeat(size, size))], ["node", "label", "key", "n"])


def _by_prefix(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, label: the shingles by which the nodes' linked pairs are sure to meet.

    Linked sets share percent/100 of the shingles of either. So each shares one of its n - ceil(n * percent/100) + 1 rarest,
    in one order for all, with the other's. The edits of a near-copy are rare, so crowded buckets of documents
    that are alike, but not linked, fall apart.
    """
    flat = nodes.join(sets, "node").select("node", "label", "shingles").mapInArrow(_flat, "node long, label long, key long, n long")
    flat = stored(flat, "near-flat")
    often = stored(flat.groupBy("key").agg(F.count("*").alias("often")), "near-often")
    ranked = flat.join(often, "key").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("all"))
    first = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    met = ranked.select("node", "label", F.explode(F.filter(first, lambda x: x["often"] > 1)).alias("x"))
    return stored(met.select(F.col("x.key").alias("key"), "node", "label"), "near-prefix")


def _by_piece(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("piece").sortWithinPartitions("piece")


def _in_crowds(nodes: DataFrame, regs: DataFrame, sets: DataFrame, m: int, least: float, percent: int) -> DataFrame:
    """a, b: links that join what the labels of the nodes do not, of all linked pairs with a shingle of their prefixes in common.

    Buckets of a shingle hold registers only. The pairs there that are likely, so far as they join their bucket's rows,
    make crowds: each likely pair is inside one. A pair that meets in many buckets is in one crowd only, so a
    whole set is copied once for each piece of its crowd, not for each of its shingles.
    """
    known = _by_prefix(nodes, sets, percent)
    pieces = stored(_pieces(known.join(_mixed(known), "key"), True), "near-meet").join(regs, "node").select("piece", "side", "node", "label", "n", "regs")
    likely = stored(_by_piece(pieces).mapInArrow(_partners(m, least, joining=True), "a long, b long").distinct(), "near-meetings")
    crowds = components(likely).withColumnRenamed("label", "key")
    known = stored(nodes.select("node", "label").join(crowds, "node").select("key", "node", "label"), "near-crowds")
    pieces = stored(_pieces(known.join(_mixed(known), "key"), True), "near-dealt").join(regs, "node").join(sets, "node")
    pieces = pieces.select("piece", "side", "node", "label", "n", "regs", "shingles")
    return stored(_by_piece(pieces).mapInArrow(_partners(m, least, percent), "a long, b long").distinct(), "near-joined")


def _mixed(known: DataFrame) -> DataFrame:
    """key, major (its most frequent label), minors and majors (rows of the others and of it), of buckets of several labels."""
    by_label = known.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    return stored(mixed.select("key", F.col("m.label").alias("major"), F.col("m.c").alias("majors"), (F.col("all") - F.col("m.c")).alias("minors")), "near-mixed")


def _pieces(rows: DataFrame, whole: bool) -> DataFrame:
    """Deal the rows of mixed buckets into pieces of about PIECE rows a side.

    Unless `whole`, each row is in one piece. Else minors meet all minors and all majors: minors are copied once for
    each piece of majors and of minors, majors once for each piece of minors.
    """
    dealt = F.xxhash64("node", "key")
    if not whole:
        piece = F.pmod(dealt, F.ceil((F.col("majors") + F.col("minors")) / PIECE))
        return rows.select("node", "label", F.lit(0).alias("side"), F.xxhash64("key", piece).alias("piece"))
    minor = F.col("label") != F.col("major")
    many, most = F.ceil(F.col("minors") / PIECE), F.ceil(F.col("majors") / PIECE)
    own = F.when(minor, F.pmod(dealt, many)).otherwise(F.pmod(dealt, most))
    rows = rows.withColumns({"many": many, "most": most, "own": own, "minor": minor})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    entry = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    with_majors = F.transform(upto(F.col("most")), lambda j: entry("x", own, j, zero))
    with_minors = F.transform(upto(F.col("many")), lambda j: entry("o", F.least(own, j), F.greatest(own, j), F.when(own <= j, zero).otherwise(one)))
    as_major = F.transform(upto(F.col("many")), lambda i: entry("x", i, own, one))
    places = F.when(F.col("minor"), F.concat(with_majors, with_minors)).otherwise(as_major)
    return rows.select("node", "label", "key", F.explode(places).alias("p")).select("node", "label", "p.side", F.xxhash64("key", "p.kind", "p.i", "p.j").alias("piece"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each component the smallest doc_id; columns as in docs, whatever their names.

    Rows that share the doc_id that stays all stay. Null and empty texts and null ids stay; texts are compared whole; an empty
    table gives no rows.
    """
    (gone_,) = free_names(docs, "id_of_gone")
    with scratch(docs.sparkSession):
        found = near_duplicates(docs.select("doc_id", "text"), **options).where("not kept")
        gone = stored(found.select(F.col("doc_id").alias(gone_)).distinct(), "near-gone", keep=True)
    return docs.join(gone, F.col("doc_id") == F.col(gone_), "left_anti").select(*docs.columns)
