"""Operator 3: exact n-gram Jaccard join by universe partition and pigeonhole.

The universe of shingles is hashed into m segments; m depends on the size band of the larger set, so that two linked sets
of a band differ in fewer places than the segments can absorb and must agree on one of them. Segments are
allocated by cost: in bands of large sets a slack of c segments lets every set leave out its c least selective
ones (those with the fewest shingles, an order both partners share), in bands of small sets some segments
count double and are indexed with their one-deletion neighbourhood. A set is indexed in its own band and, if a larger
partner can lie there, in the next. Only signatures that different sets share survive (a grouped minimum and
maximum, no lists), and candidates are verified on whole shingle arrays.

Equal sets are one node throughout, so copies cost nothing. Candidates of a signature are first verified against its
centre: a star cannot explode. Before two sets travel to be compared, short sketches of parities prove most pairs unlinked.
What signatures still hold of different components meets as sketches inside a task, in blocks of bounded size; only sets that
a sketch can't tell from a linked one are compared whole, again in blocks, as products of bit matrices. No pair of them becomes
a row, and only links that join components are given, so no link between components is lost. Nodes are named by a 64-bit hash
of their set.

Defined results: null and empty texts have no shingles and are linked with nothing; rows of equal doc_id are sets of
their own that share an id; a null doc_id links like any other but never names a component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbytes as tb
from .components import components, extended

PARTS = 2  # passes over the range of signatures
SHINGLES = 200_000  # of a block, with 100 for each set; a single longer set makes a larger one
STRIP = 256  # sets of a block of sketches compared with all others at once
SKETCHES = 1 << 18  # bytes of a block of sketches, with 120 for each set
COLUMNS = 2048  # of a bit matrix at a time
NODES = 1 << 16  # that a task holds to connect them
_C = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


@dataclass(frozen=True)
class Band:
    """Sizes lo..hi: m segments, the first `double` with deletions, `slack` segments left out; `part` of 100 is the threshold."""

    lo: int
    hi: int
    m: int
    double: int
    slack: int


@lru_cache(10_000)
def band(index: int, percent: int) -> Band:
    lo, hi = edge(index, percent), edge(index + 1, percent) - 1
    apart = (100 - percent) * 2 * hi // (100 + percent)  # |r| + |s| - 2 |r and s| of linked sets up to hi
    best = None
    for double in range(apart // 2 + 2) if hi <= 64 else (0,):
        slack = apart // (8 if percent >= 85 else 2) if not double else 0
        m = max(apart + 1 + slack - double, double, 1)
        mean = lo / m
        empty = np.exp(-mean) * (1 + mean * (double > 0))
        cost = m - double + double * (1 + mean) + 200 * max(0.0, m * empty - slack)
        if best is None or cost < best[0]:
            best = cost, Band(lo, hi, m, double, slack)
    return best[1]


@lru_cache(10_000)
def edge(index: int, percent: int) -> int:
    """Smallest size of a band. Lower thresholds mean smaller segments, so their bands are narrower; a partner is at most one band away."""
    ratio = 1.6 if percent >= 85 else max(1.3, 104 / percent)
    return index + 1 if index < 3 else max(edge(index - 1, percent) + 1, int(edge(index - 1, percent) * ratio))


def sets(b: tb.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, and the offsets of the texts; fewer words are one shingle."""
    start, end, at = tb.words(b, tb.SPACED, fold=True)
    h = tb.span_hash(tb.prefix(b.data, True), start, end)
    n = np.diff(at)
    gram = tb.gram_hash(h, k)
    doc = np.repeat(np.arange(b.n), n)
    whole = doc[k - 1:] == doc[:len(doc) - k + 1] if len(gram) else np.zeros(0, bool)
    token, owner = [gram[whole]], [doc[:len(gram)][whole]]
    for short in range(1, k):
        own = np.flatnonzero(n == short)
        if len(own):
            value = np.full(len(own), short, np.uint64) * _C[3]
            for i in range(short):
                value = tb.mix(value + h[at[own] + i] * _C[2])
            token.append(value)
            owner.append(own)
    token, owner = np.concatenate(token), np.concatenate(owner)
    order = np.argsort(token)
    order = order[np.argsort(owner[order].astype(np.uint16 if b.n < 1 << 16 else np.int64), kind="stable")]
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(b.n + 1))


def span_sums(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def nodes(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    return tb.mix(span_sums(tb.mix(token + _C[0]), at) + np.diff(at).astype(np.uint64) * _C[1])


def signatures(token: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of all sets token[at[i]:at[i+1]]."""
    size = np.diff(at)
    edges = [edge(0, percent)]
    while edges[-1] <= size.max(initial=0):
        edges.append(edge(len(edges), percent))
    own = np.searchsorted(edges, size, "right") - 1
    nxt = own + 1
    up = (size > 0) & (100 * size >= percent * np.array([edge(i, percent) for i in range(len(edges) + 1)])[nxt])
    out = [_signed(token, at, np.flatnonzero(size > 0), own, percent), _signed(token, at, np.flatnonzero(up), nxt, percent)]
    return np.concatenate([s for s, _ in out]), np.concatenate([d for _, d in out])


def _signed(token, at, docs, of_band, percent):
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kinds = [band(int(i), percent) for i in range(int(of_band[docs].max()) + 1)]
    m, double, slack = (np.array([getattr(k, f) for k in kinds])[of_band[docs]] for f in ("m", "double", "slack"))
    size = np.diff(at)[docs]
    first = np.cumsum(m) - m  # of the segments of each set
    doc = np.repeat(np.arange(len(docs)), size)
    own = token[np.repeat(at[docs] - (np.cumsum(size) - size), size) + np.arange(len(doc))]
    value = tb.mix(own + _C[2])
    place = first[doc] + (tb.mix(own + _C[3]) >> np.uint64(32)).astype(np.int64) % m[doc]
    many = np.bincount(place, minlength=int(m.sum()))
    order = np.argsort(place, kind="stable")
    content = span_sums(value[order], np.concatenate([[0], np.cumsum(many)]))
    of_segment = np.repeat(np.arange(len(docs)), m)
    index = np.arange(len(many)) - first[of_segment]
    tag = (of_band[docs][of_segment].astype(np.uint64) << np.uint64(32) | index.astype(np.uint64)) * _C[1]
    name = tb.mix(content + tag)
    rank = np.empty(len(name), np.int64)
    rank[np.lexsort((name, many, of_segment))] = index  # fewest shingles first; ties by content
    keep = rank >= slack[of_segment]
    doubled = (index < double[of_segment])[place]
    less = tb.mix(content[place[doubled]] - value[doubled] + tag[place[doubled]])
    return np.concatenate([name[keep], less]), docs[np.concatenate([of_segment[keep], doc[doubled]])]


def measured(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, node of every document."""

    def rows(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(1)):
                token, at = sets(b, k)
                yield {"doc_id": batch.column(0).slice(b.first, b.n), "n_shingles": np.diff(at), "node": nodes(token, at).view(np.int64)}

    return store.map_arrow(store.texts(docs, "doc_id"), rows, "doc_id long, n_shingles long, node long")


def signed(docs: DataFrame, k: int, percent: int, part: int = 0, parts: int = 1) -> DataFrame:
    """sig, node: the signatures of every set that fall into a part of their range, once for equal sets of a block."""

    def rows(batches):
        for batch in batches:
            for b in tb.blocks(batch.column(0)):
                token, at = sets(b, k)
                node = nodes(token, at)
                _, once = np.unique(node, return_index=True)
                repeat = np.ones(b.n, bool)
                repeat[once] = False
                if repeat.any():
                    token = token[~np.repeat(repeat, np.diff(at))]
                    at = np.concatenate([[0], np.cumsum(np.diff(at)[~repeat])])
                    node = node[~repeat]
                sig, doc = signatures(token, at, percent)
                here = sig % np.uint64(parts) == part
                yield {"sig": sig[here].view(np.int64), "node": node[doc[here]].view(np.int64)}

    return store.map_arrow(store.texts(docs), rows, "sig long, node long")


def shared(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """sig, node, centre: the signatures that different sets share, with the smallest node of each.

    The range of signatures is done in `PARTS` passes, and each pass moves its signatures once: sets are told apart
    and centres found where the signature has been dealt to. What only one set has ends there.
    """
    w = Window.partitionBy("sig").orderBy("node")
    parts = []
    for part in range(PARTS):
        dealt = signed(docs, k, percent, part, PARTS).repartition("sig").dropDuplicates(["sig", "node"])
        centred = dealt.withColumn("centre", F.first("node").over(w)).withColumn("more", F.lead("node").over(w).isNotNull())
        parts.append(store.kept(centred.where("more or node <> centre").drop("more"), "shared-signatures"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    whole = store.kept(out, "shared-signatures") if len(parts) > 1 else out
    store.free(*[p for p in parts if p is not whole])
    return whole


def shingles(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, tokens (sorted 64-bit numbers as bytes) of the nodes in `wanted` (node, doc_id: a document that has it)."""
    w = wanted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc")).distinct()
    given = store.texts(docs, "doc_id")
    some = given.join(w, given["doc_id"].eqNullSafe(w["_doc"])).select("_node", "text")

    def rows(batches):
        for batch in batches:
            want = batch.column(0).to_numpy(zero_copy_only=False)
            for b in tb.blocks(batch.column(1)):
                token, at = sets(b, k)
                right = np.flatnonzero(nodes(token, at).view(np.int64) == want[b.first:b.first + b.n])
                if len(right):
                    yield {"node": want[b.first + right], "tokens": pa.array([token[at[i]:at[i + 1]].tobytes() for i in right.tolist()], pa.binary())}

    return store.map_arrow(some, rows, "node long, tokens binary").dropDuplicates(["node"])


def sketched(tokens: DataFrame) -> DataFrame:
    """node, n, bits: the size of each set and the parities of its shingles on 2 to 4 bits a shingle.

    Two sets differ in at least as many shingles as their parities differ in bits, so too many bits prove that two sets
    aren't linked. A sketch is folded to half its length by xor.
    """

    def rows(batches):
        for batch in batches:
            n, bits = [], []
            for value in batch.column(1):
                token = np.frombuffer(value.as_buffer(), np.uint64)
                width = max(64, 1 << (2 * len(token) - 1).bit_length())
                place = (tb.mix(token + _C[2]) & np.uint64(width - 1)).astype(np.int64)
                n.append(len(token))
                bits.append(np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield {"node": batch.column(0), "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())}

    return store.map_arrow(tokens.select("node", "tokens"), rows, "node long, n long, bits binary")


def apart(n, percent: int):
    """In how many shingles two linked sets of n shingles together may differ."""
    return n - 2 * -(-percent * n // (100 + percent))


def close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and sketches don't prove unlinked."""
    one, two = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def rows(batches):
        for batch in batches:
            na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(2, 6))
            good = []
            for m, n, x, y in zip(na, nb, sa, sb, strict=True):
                if len(x) < len(y):
                    x, y = y, x
                p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
                if len(x) > len(y):
                    p = p >> 8 * len(y) ^ p & (1 << 8 * len(y)) - 1
                good.append((p ^ q).bit_count() <= apart(m + n, percent))
            keep = pa.array(good, pa.bool_())
            yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return store.map_arrow(both.select("a", "b", "na", "nb", "sa", "sb"), rows, "a long, b long")


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, by the intersection of their whole sets."""
    one, two = (tokens.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")

    def rows(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                r, s = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                small, large = (r, s) if len(r) < len(s) else (s, r)
                place = np.searchsorted(large, small)
                both = int((large[np.minimum(place, len(large) - 1)] == small).sum()) if len(large) else 0
                good.append((100 + percent) * both >= percent * (len(r) + len(s)))
            keep = pa.array(good, pa.bool_())
            yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return store.map_arrow(both, rows, "a long, b long")


def mixed(found: DataFrame, root: DataFrame) -> DataFrame:
    """sig, node, root of the signatures that more than one component has."""
    placed = found.join(root.select("node", "root"), "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    w = Window.partitionBy("sig").orderBy("root")
    ends = placed.withColumn("low", F.first("root").over(w)).withColumn("high", F.first("root").over(Window.partitionBy("sig").orderBy(F.desc("root"))))
    return ends.where("low < high").select("sig", "node", "root")


def once(rest: DataFrame) -> DataFrame:
    """Of signatures that the same sets share, one; they are told apart by two 64-bit sums and their number."""
    kinds = rest.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y"))
    return rest.join(kinds.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def top(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def forest(edges, parent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Those of the edges that join what was apart, in their order; `parent` (of what is joined already) takes them in."""
    parent = {} if parent is None else parent
    out = []
    for a, b in edges:
        x, y = top(parent, a), top(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def unproved(node: np.ndarray, root: np.ndarray, side: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that span all pairs on the two sides (of all sets where there is one side) of different components that sizes and
    sketches don't prove unlinked."""
    size = np.array([len(b) for b in bits])
    edges = []
    for width in np.unique(size).tolist():
        here, wider = np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)
        flat = lambda some, w: np.unpackbits(np.frombuffer(b"".join(bits[i] for i in some.tolist()), np.uint8).reshape(-1, w), axis=1, bitorder="little")
        own, folded = flat(here, width), flat(wider, 2 * width)
        both = np.concatenate([own, folded[:, :8 * width] ^ folded[:, 8 * width:]]).astype(np.float32)
        other = np.concatenate([here, wider])
        ones = both.sum(1)
        for at in range(0, len(here), STRIP):
            row = here[at:at + STRIP]
            end = at + len(row)
            differ = ones[at:end, None] + ones[None, :] - 2 * (both[at:end] @ both.T)
            m, o = n[row][:, None], n[other][None, :]
            good = (differ <= apart(m + o, percent)) & (100 * np.minimum(m, o) >= percent * np.maximum(m, o)) & (root[row][:, None] != root[other][None, :])
            if side.min() < side.max():
                good &= side[row][:, None] != side[other][None, :]
            i, j = np.nonzero(good)
            edges += forest(zip(node[row[i]].tolist(), node[other[j]].tolist(), strict=True))
    return forest(edges)


def suspected(rest: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all sets of open signatures (sig, node, root) which their sketches don't prove unlinked.

    The sets of a signature meet as sketches, in blocks of about `SKETCHES` bytes; a task holds two blocks at a time.
    """
    member = once(rest).join(sketches, "node")
    dealt = member.groupBy("sig").agg(F.ceil(F.sum(F.octet_length("bits") + 120) / SKETCHES).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    placed = member.join(dealt, "sig").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    given = placed.select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "root", "n", "bits")
    solve = lambda held: unproved(*(np.array([h[i] for h in held], np.int64) for i in (1, 2, 0, 3)), [h[4] for h in held], percent)
    return in_groups(given, ["sig", "x", "y"], lambda groups: stars(chain.from_iterable(map(solve, groups))))


def stars(edges):
    """Lists of edges that connect what the edges connect, each node but the smallest of a component with that one.

    Each group connects its sets by edges of its own, so their number would grow with that of the groups: with the square
    of a family's size where that is dealt into blocks. These are fewer than the nodes of a task, or of each `NODES` of them.
    """
    parent: dict[int, int] = {}
    for edge in edges:
        forest([edge], parent)
        if len(parent) >= NODES:
            yield [(top(parent, x), x) for x in list(parent)]
            parent = {}
    yield [(top(parent, x), x) for x in list(parent)]


def in_groups(rows_: DataFrame, keys: list[str], solve) -> DataFrame:
    """Edges (a, b) of the lists that `solve` makes of a task's groups of equal keys, each a list of its other columns.

    A task holds one group at a time.
    """
    k = len(keys)

    def groups(batches):
        key, held = None, []
        for row in (r for batch in batches for at in range(0, batch.num_rows, 256) for r in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)):
            if row[:k] != key:
                if held:
                    yield held
                key, held = row[:k], []
            held.append(row[k:])
        if held:
            yield held

    def rows(batches):
        for pairs in solve(groups(batches)):
            yield {"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())}

    return store.map_arrow(rows_.repartition(*keys).sortWithinPartitions(*keys), rows, "a long, b long")


def products(node: np.ndarray, root: np.ndarray, side: np.ndarray, tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different components, of sets on the two sides (of all sets where there is one side)."""
    size = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    names, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(tokens)), size)
    shared = many[column] > 1
    number = np.cumsum(many > 1) - 1
    row, column = row[shared], number[column[shared]]
    one = np.flatnonzero(side == side.min())
    two = np.flatnonzero(side == side.max())
    both = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(tokens), COLUMNS), np.float32)
        part[row[a:z], column[a:z] - first] = 1
        both += part[one] @ part[two].T
    good = (100 + percent) * both.astype(np.int64) >= percent * (size[one][:, None] + size[two][None, :])
    good &= root[one][:, None] != root[two][None, :]
    i, j = np.nonzero(good)
    links = {}
    for x, y, a, b in zip(root[one[i]].tolist(), root[two[j]].tolist(), node[one[i]].tolist(), node[two[j]].tolist(), strict=True):
        links.setdefault((x, y), (a, b))
    return [links[e] for e in forest(links)]  # only what joins what is apart


def blocks(edges: DataFrame, root: DataFrame, tokens: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, of the sets that edges (a, b) connect to families.

    A family is dealt into blocks of about `SHINGLES` shingles, every two blocks meet in one group, and a task holds one
    group at a time.
    """
    families = components(edges)
    own = families.select("node", F.col("root").alias("family")).join(root.select("node", F.col("root").alias("own")), "node", "left")
    member = store.kept(own.withColumn("own", F.coalesce("own", "node")).join(sizes, "node"), "families")
    store.free(families)
    dealt = member.groupBy("family").agg(F.ceil(F.sum(F.col("n") + 100) / SHINGLES).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    placed = member.join(dealt, "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    given = placed.select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "own").join(tokens, "node")
    given = given.select("family", "x", "y", "block", "node", "own", "tokens")
    solve = lambda held: products(*(np.array([h[i] for h in held], np.int64) for i in (1, 2, 0)), [np.frombuffer(h[3], np.uint64) for h in held], percent)
    return in_groups(given, ["family", "x", "y"], lambda groups: map(solve, groups))


def linked(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    known = store.kept(measured(docs, k), "set-nodes")
    named = known.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    found = shared(docs, k, percent)  # sig, node, centre
    tokens = store.kept(shingles(docs, found.select("node").distinct().join(named, "node"), k), "shared-sets")
    sketches = store.kept(sketched(tokens), "sketches")
    # 1: each node with the centre that shares most of its signatures
    stars = found.where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("votes"))
    best = stars.groupBy(F.col("node").alias("b")).agg(F.max_by("centre", F.struct("votes", "centre")).alias("a")).select("a", "b")
    tried = store.kept(close(best, sketches, percent), "pairs-1")
    links = store.kept(verified(tried, tokens, percent), "links-1")
    root = components(links)
    # 2: each node with the centres of its signatures that are still in another component
    open_ = store.kept(mixed(found, root), "open-signatures")
    store.free(found)
    centre = open_.groupBy("sig").agg(F.min(F.struct("root", "node")).alias("first"))
    pairs = open_.join(centre, "sig").where("root <> first.root").select(F.col("first.node").alias("x"), F.col("node").alias("y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    new = store.kept(close(pairs.join(done, ["a", "b"], "left_anti"), sketches, percent), "pairs-2")
    more = store.kept(verified(new, tokens, percent), "links-2")
    if not more.isEmpty():
        root = extended(root, more)
    # 3: whatever signatures still hold of different components and sketches can't tell apart, in blocks
    rest = store.kept(mixed(open_.select("sig", "node"), root), "open-signatures")
    store.free(open_)
    edges = store.kept(suspected(rest, sketches, percent), "suspected")
    if not edges.isEmpty():
        more = store.kept(blocks(edges, root, tokens, sketches.select("node", "n"), percent), "links-3")
        if not more.isEmpty():
            root = extended(root, more)
    store.free(rest, tokens, sketches, edges)
    placed = known.join(root.select("node", "root"), "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    names = placed.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    out = placed.join(names, "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
