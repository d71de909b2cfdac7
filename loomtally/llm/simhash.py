"""SimHash near-duplicates with BK-trees.

Fingerprint: words are cut at ASCII white space and A-Z lower-cased, shingles of
`width` words (repeats count) are hashed by XXH64 with seed 42, and a bit is set
if it is set in over half of the hashes.

Distinct fingerprints are the nodes. They are dealt to shards by routes: a route
is a mask of fingerprint bits, and a shard holds the fingerprints that agree on
its route's bits. With `exact_routes(radius)` any two fingerprints within the
radius share a shard (64 bits in radius + 2 blocks, all but `radius` of which
agree), so the union over shards loses no link. A shard is one BK-tree: children
are keyed by the Hamming distance to their parent, and a search follows the edges
within the radius of the query's distance. A tree goes to the task of its shard's
queries and nowhere else: handing every tree to every task would make each
fingerprint search all of them, which grows with the square of the corpus. A shard
of over `shard_limit` fingerprints is dealt again by routes over its other bits.

A shard gives each node its root (the least node it reaches within the shard), at
most one row a node, however dense; components are then found over all shards.

The pipeline's near-duplicates (near_duplicate_groups) are found by the same fingerprints and
trees at a radius that fits the similarity: texts alike in 0.8 of their shingles differ in 15 % of
the bits, 10 of 64 on average and 16 at most but for one in fifty. No exact routes are small enough
there, so routes are sampled, and each fingerprint asks for the nearest one before it in each of its
shards. Unlike texts that meet by chance are told by 64 more bits, of other hashes of the same
shingles. The pairs are then decided by exact Jaccard similarity of shingle sets. Alike texts that share no shard, or whose
nearest is another, are found by an exact join on the prefixes of the sets, which compares no pair
again that the fingerprints have brought.

Defined results: null and empty texts have fingerprint 0, linked like any other;
fewer words than a shingle are one shingle; equal ids or texts are rows of their
own and share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.llm.components import components
from loomtally.llm.encoders import forget
from loomtally.session import durable, release_memory

BITS = 64
#: Bits of the table that marks the texts to be compared: 32 MB, broadcast and held by the driver.
MARK_BITS = 1 << 28
#: Texts, and pairs of texts, that a Python worker is handed at a time.
TEXT_ROWS, PAIR_ROWS = 2048, 512


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, span = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - span + 1
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[span - 1 :].tolist(), strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The 64 majority bits of the hashes; 0 for none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for a fingerprint of bits of their own."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exact_routes(radius: int) -> list[int]:
    """Masks of which two fingerprints within the radius agree on one at least: the bits
    in radius + 2 blocks, every choice of two blocks."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


class BKTree:
    """A tree of fingerprints; a child is keyed by its distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, place) of all within the radius."""
        if not self.values:
            return []
        values, children, found, todo = self.values, self.children, [], [0]
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            below = children[at]
            if below:
                lo, hi = d - radius, d + radius
                todo.extend([c for e, c in below.items() if lo <= e <= hi])
        return found

    def nearest(self, value: int, radius: int) -> int | None:
        """Place of the nearest within the radius, which shrinks as nearer ones are found."""
        if not self.values:
            return None
        values, children, best, todo = self.values, self.children, None, [(0, 0)]
        while todo and radius >= 0:
            least, at = todo.pop()
            if least > radius:
                continue
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                best, radius = at, d - 1
            # a child at edge e is no nearer than |e - d|; the likeliest comes last
            todo.extend(sorted([(abs(e - d), c) for e, c in children[at].items() if abs(e - d) <= radius], reverse=True))
        return best

    def add(self, value: int) -> int:
        """Place of the value, which is added if it is new."""
        new, at = len(self.values), 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return new


def _roots(shard: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(node, root) of every node of the shard that reaches a lesser one."""
    tree, parent = BKTree(), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in sorted(shard):
        found = {find(i) for _, i in tree.near(value, radius)}
        place = tree.add(value)
        parent.append(place)
        least = min(found, default=place)
        for i in (*found, place):
            parent[i] = least
    for i, value in enumerate(tree.values):
        if (root := find(i)) != i:
            yield value, tree.values[root]


def _nearest(shard: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(node, the nearest of the lesser ones within the radius) of every node of the shard that has one."""
    tree = BKTree()
    for value in sorted(shard):
        found = tree.nearest(value, radius)
        if found is not None:
            yield value, tree.values[found]
        tree.add(value)


def sampled_routes(count: int, bits: int, seed: int = 7) -> list[int]:
    """Masks of `bits` bits each, drawn anew: two fingerprints at distance d agree on one with
    probability about (1 - d / 64) ** bits."""
    rng = np.random.default_rng([seed, bits])
    return [sum(1 << int(b) for b in rng.choice(BITS, bits, replace=False)) for _ in range(count)]


def _routed(nodes: DataFrame, routes: Sequence[int]) -> DataFrame:
    """fp, route, key for each fingerprint and route; key: a hash of the route and of the
    bits that its shard agrees on (shards that share a hash are searched as one)."""
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in routes])
    bits = F.col("fp").bitwiseAND(F.col("mask"))
    return nodes.select("fp", F.posexplode(masks).alias("route", "mask")).select("fp", "route", F.xxhash64("route", bits).alias("key"))


def _dealt_again(routed: DataFrame, routes: Sequence[int], radius: int) -> DataFrame:
    """fp, key of crowded shards dealt by the bits outside their route's mask, in `radius` + 2
    parts of which two agree within the radius."""
    parts = radius + 2
    masks = []
    for mask in routes:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        split = [sum(1 << b for b in rest[i::parts]) for i in range(parts)]
        masks.append(F.array(*[F.lit(signed(x | y)).cast("long") for x, y in itertools.combinations(split, 2)]))
    bits = F.col("fp").bitwiseAND(F.col("mask"))
    return routed.select("fp", "key", F.posexplode(F.element_at(F.array(*masks), F.col("route") + 1)).alias("part", "mask")).select("fp", F.xxhash64("key", "part", bits).alias("key"))


def _dealt_finer(routed: DataFrame, routes: Sequence[int], radius: int, times: int = 3, bits: int = 8) -> DataFrame:
    """fp, key of crowded shards dealt by some bits outside their route's mask, several times over:
    for routes that are sampled themselves."""
    masks = []
    for i, mask in enumerate(routes):
        rest = [b for b in range(BITS) if not mask >> b & 1]
        rng = np.random.default_rng([i, len(rest)])
        masks.append(F.array(*[F.lit(signed(mask | sum(1 << int(b) for b in rng.choice(rest, bits, replace=False)))).cast("long") for _ in range(times)]))
    agreed = F.col("fp").bitwiseAND(F.col("mask"))
    return routed.select("fp", "key", F.posexplode(F.element_at(F.array(*masks), F.col("route") + 1)).alias("part", "mask")).select("fp", F.xxhash64("key", "part", agreed).alias("key"))


def shard_links(
    nodes: DataFrame, radius: int, routes: Sequence[int], shard_limit: int = 4096, of_shard: Callable[[list[int], int], Iterator[tuple[int, int]]] = _roots, again: Callable[..., DataFrame] = _dealt_again
) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `nodes` (column fp, durable):
    each node's root in every shard, or what else of_shard gives. again: how crowded shards are dealt."""
    routed = _routed(nodes, routes)
    full = durable(routed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_limit).select(F.col("key").alias("_full")), "crowded")
    dealt = routed.select("fp", "key")
    if full.limit(1).count():
        crowded = F.col("key") == F.col("_full")
        dealt = dealt.join(full, crowded, "left_anti").unionByName(again(routed.join(full, crowded, "left_semi"), routes, radius))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] | None = None  # the rows of the last shard so far

        def links(rows: np.ndarray) -> list[tuple[int, int]]:
            edge = np.nonzero(rows[1:, 0] != rows[:-1, 0])[0] + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows)]])
            out: list[tuple[int, int]] = []
            for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                shard = [x & 0xFFFFFFFFFFFFFFFF for x in rows[a:b, 1].tolist()]
                if b - a == 2 and (shard[0] ^ shard[1]).bit_count() > radius:
                    continue
                out += of_shard(shard, radius)
            return out

        for batch in batches:
            rows = batch.to_numpy(dtype=np.int64)
            if held is not None:
                rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            same = rows[:, 0] == rows[-1, 0]
            cut = 0 if same.all() else int(len(rows) - np.argmin(same[::-1]))
            held = rows[cut:]
            if cut:
                yield _edges(links(rows[:cut]))
        if held is not None and len(held):
            yield _edges(links(held))

    def _edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
        got = np.array([(signed(a), signed(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return dealt.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(search, "a long, b long").distinct()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            fp = np.array([signed(simhash(shingle_hashes(t, width))) for t in batch["text"].tolist()], dtype=np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def near_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the least doc_id reachable (null if all
    reachable ids are)."""
    prints = durable(fingerprints(docs, width), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    found = components(shard_links(nodes, radius, exact_routes(radius)))
    heads = found.join(nodes, F.col("node") == F.col("fp"))
    least = heads.groupBy("label").agg(F.min("head").alias("least")).withColumnRenamed("label", "_label")
    linked = found.join(least, F.col("label") == F.col("_label")).select("node", "least")
    named = durable(nodes.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "head").alias("component_id"), "n"), "named-fingerprints")
    # fingerprints of a large share of the rows (at most 4 for each shuffle partition) are looked
    # up where the rows are, so that no task gets all rows of one
    bound = nodes.agg(F.sum("n")).first()[0] or 0
    hot = named.where(F.col("n") * (4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))) > bound)
    same = F.col("fp") == F.col("_fp")
    out = prints.join(F.broadcast(hot), same).unionByName(prints.join(F.broadcast(hot), same, "left_anti").join(named, same))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _common_shingles(docs: DataFrame, width: int, share: int = 16, least: int = 8, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, level: the bits of their count) of shingles seen in at
    least `least` texts of a `share`-th of them. They only order the others' prefixes: what is
    sampled or cut here costs candidates, never a pair."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for batch in batches:
            made = [np.unique(shingle_hashes(t, width)) for t in batch["text"].tolist()]
            s, n = np.unique(np.concatenate(made), return_counts=True) if made else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    got = part.mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(most).toPandas()  # at most `most` rows
    s = got["s"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.floor(np.log2(got["n"].to_numpy(dtype=np.float64)[order])).astype(np.int8) + 1


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Rows sorted by their first column, in frames that cut no run of equal values."""
    held: np.ndarray | None = None
    for batch in batches:
        rows = batch.to_numpy(dtype=np.int64)
        if not len(rows):
            continue
        if held is not None:
            rows = np.concatenate([held, rows])
        start = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if start:
            yield rows[:start]
        held = rows[start:]
    if held is not None:
        yield held


def _fit(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sets (n << 32 | place) whose first common shingle stands at these places of
    their prefixes can be alike in num / den."""
    low = np.int64((1 << 32) - 1)
    n, m = x >> 32, y >> 32
    return np.minimum(n - (x & low), m - (y & low)) * (num + den) >= num * (n + m)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs, the lesser first."""
    return np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)


def _candidates(prefixes: DataFrame, num: int, den: int, few: int) -> DataFrame:
    """kind, a, b, c: of prefixes (s, key, place) the pairs (0, a, b, 0) of up to `few` texts that
    share a shingle. Of more texts the pairs with one of them, and the rows themselves
    (1, s, key, place), of which _across makes the other pairs that are needed. The one is
    that with the fewest rarer shingles before the shared one: of copies, the least edited."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            s, key, place = rows.T
            first = np.concatenate([[True], s[1:] != s[:-1]])
            start = np.nonzero(first)[0]
            size = np.diff(np.append(start, len(s)))
            group = np.cumsum(first) - 1
            big = size[group] > few
            found = []
            for step in range(1, few):
                i = np.nonzero((s[:-step] == s[step:]) & ~big[:-step])[0] if step < len(s) else np.zeros(0, dtype=np.int64)
                if not len(i):
                    break
                i = i[_fit(place[i], place[i + step], num, den)]
                found.append(np.column_stack([key[i], key[i + step]]))
            j = np.nonzero(big & ~first)[0]
            i = start[group[j]]
            ok = _fit(place[i], place[j], num, den)
            found.append(np.column_stack([key[i[ok]], key[j[ok]]]))
            pairs = np.concatenate(found)
            pairs = _pairs(pairs[:, 0], pairs[:, 1])
            none = np.zeros(len(pairs), dtype=np.int64)
            yield pd.DataFrame({"kind": none.astype(np.int32), "a": pairs[:, 0], "b": pairs[:, 1], "c": none})
            if big.any():
                yield pd.DataFrame({"kind": np.ones(int(big.sum()), dtype=np.int32), "a": s[big], "b": key[big], "c": place[big]})
        release_memory()

    return prefixes.repartition("s").sortWithinPartitions("s", F.col("place").bitwiseAND((1 << 32) - 1), "key").mapInPandas(run, "kind int, a long, b long, c long")


def _across(named: DataFrame, num: int, den: int, turn: int, most: int, last: bool) -> DataFrame:
    """kind, a, b of groups (s, key, place, label, parity): all pairs (0, a, b) of texts in unlike
    components, where these are at most `most` a text or it is the last turn. Else the pairs
    with one text, another each turn, and (1, s, 0): the group stays open. Pairs that cannot be
    alike by their places or parities are left out."""

    def of(s: int, key: np.ndarray, place: np.ndarray, label: np.ndarray, made: list[bytes], out: list[np.ndarray]) -> bool:
        m = np.unique(label, return_counts=True)[1]
        if len(m) < 2:
            return False
        n, bits = place >> 32, _Parities(made)

        def add(i: int, j: np.ndarray) -> None:
            j = j[_fit(place[i], place[j], num, den)]
            # alike in num / den: the sets differ in at most (den - num) / (den + num) of both sizes
            j = j[bits.differ(i, j) * (den + num) <= (den - num) * (n[i] + n[j])]
            out.append(np.column_stack([np.full(len(j), key[i]), key[j]]))

        if not last and len(key) ** 2 - (m**2).sum() > 2 * most * len(key):
            i = int(np.argmin((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(turn) * np.uint64(0xBF58476D1CE4E5B9))))
            add(i, np.nonzero(label != label[i])[0])
            return True
        for i in range(len(key) - 1):
            add(i, np.nonzero(label[i + 1 :] != label[i])[0] + i + 1)
        return False

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of whole groups."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            s = batch["s"].to_numpy(dtype=np.int64)
            if not len(s):
                continue
            start = int(np.searchsorted(s, s[-1]))
            if start or (held and held[-1]["s"].iloc[-1] != s[-1]):
                yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
                held = []
            held.append(batch.iloc[start:])
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(batches):
            rows = frame[["s", "key", "place", "label"]].to_numpy(dtype=np.int64)
            made = frame["parity"].tolist()
            cuts = np.concatenate([[0], np.nonzero(rows[1:, 0] != rows[:-1, 0])[0] + 1, [len(rows)]])
            out, still = [np.zeros((0, 2), dtype=np.int64)], []
            for a, b in itertools.pairwise(cuts.tolist()):
                if of(rows[a, 0], *rows[a:b, 1:].T.copy(), made[a:b], out):
                    still.append(int(rows[a, 0]))
                if sum(map(len, out)) > 1 << 20:
                    pairs = np.concatenate(out)
                    out = [_pairs(pairs[:, 0], pairs[:, 1])]
                    if len(out[0]) > 1 << 19:
                        yield pd.DataFrame({"kind": np.zeros(len(out[0]), dtype=np.int32), "a": out[0][:, 0], "b": out[0][:, 1]})
                        out = [np.zeros((0, 2), dtype=np.int64)]
            pairs = np.concatenate(out)
            pairs = _pairs(pairs[:, 0], pairs[:, 1])
            yield pd.DataFrame({"kind": np.zeros(len(pairs), dtype=np.int32), "a": pairs[:, 0], "b": pairs[:, 1]})
            yield pd.DataFrame({"kind": np.ones(len(still), dtype=np.int32), "a": np.array(still, dtype=np.int64), "b": np.zeros(len(still), dtype=np.int64)})
        release_memory()

    return named.select("s", "key", "place", "label", "parity").repartition("s").sortWithinPartitions("s").mapInPandas(run, "kind int, a long, b long")


def text_key(text: str | None) -> int:
    """One for texts that are equal but for white space and ASCII case."""
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 42))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_key_column(text: Column) -> Column:
    """text_key as a column function."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.xxhash64(F.trim(F.regexp_replace(lowered, "[ \\t-\\r]+", " ")))


def parity(hashes: np.ndarray) -> bytes:
    """For each of 2 n bits or more, whether an odd number of the n hashes falls on it. Two
    sets differ in at least as many hashes as their parities differ in bits."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(counts & 1, bitorder="little").tobytes()


class _Parities:
    """The parities of a group's members, compared at the lesser of two widths."""

    def __init__(self, made: list[bytes]):
        self.width = np.array([len(m) for m in made], dtype=np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(made), dtype=np.int64)
        for w in np.unique(self.width).tolist():
            at = np.nonzero(self.width == w)[0]
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join([made[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), w)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _at(self, w: int, to: int) -> np.ndarray:
        """The parities of width w, folded to `to` bytes."""
        if w == to:
            return self.rows[w]
        if (w, to) not in self.folded:
            self.folded[w, to] = np.bitwise_xor.reduce(self.rows[w].reshape(len(self.rows[w]), w // to, to), axis=1)
        return self.folded[w, to]

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bits in which i differs from each of others: no more than their sets differ in hashes."""
        out, own = np.zeros(len(others), dtype=np.int64), int(self.width[i])
        for w in np.unique(self.width[others]).tolist():
            to, on = min(w, own), self.width[others] == w
            mine = self._at(own, to)[self.place[i]]
            there = self._at(w, to)[self.place[others[on]]]
            out[on] = np.bitwise_count(there ^ mine).sum(axis=1, dtype=np.int64)
        return out


def _asked_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """text_key, text of the texts in pairs (a, b). Before the shuffle most others are left
    out by a table of 8 to 16 bits for each text that is asked for, of MARK_BITS at most
    (with more texts it leaves out fewer, and right it stays)."""
    asked = durable(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "asked")
    size = min(MARK_BITS, 1 << max(10, (8 * asked.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(size - 1))
    words = asked.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    table = np.zeros(size >> 6, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        held = shared.value
        for batch in batches:
            keys = np.array([text_key(t) for t in batch["text"].tolist()], dtype=np.int64)
            at = keys & (size - 1)
            hit = (held[at >> 6] >> (at & 63)) & 1 == 1
            yield pd.DataFrame({"text_key": keys[hit], "text": batch["text"][hit]})

    seen = docs.select("text").where("text is not null").mapInPandas(find, "text_key long, text string")
    return durable(seen.join(asked, F.col("text_key") == F.col("key"), "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "asked-texts", batch_rows=TEXT_ROWS)


def _alike(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of text keys whose sets of shingles are alike in num / den."""
    texts = _asked_texts(docs, pairs)
    both = pairs.join(texts.select(F.col("text_key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("text_key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        known: dict[int, np.ndarray] = {}

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 2048:
                    known.clear()
                known[key] = np.unique(shingle_hashes(text, width))
            return known[key]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ta"].tolist(), batch["tb"].tolist(), strict=True):
                x, y = shingles(a, ta), shingles(b, tb)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * den >= num * (len(x) + len(y) - shared))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]
        known.clear()
        release_memory()

    return durable(both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), "alike", batch_rows=PAIR_ROWS)


def _fingerprint_pairs(prints: DataFrame, radius: int, routes: int) -> DataFrame:
    """Pairs (a, b), a < b, of text keys that the fingerprints bring, from prints (text_key, n, fp, fp2):
    texts of one fingerprint with its least, and the least ones of fingerprints that the trees link and
    whose second fingerprints differ no more either. Routes are sampled, with as many bits as leave
    about 16 fingerprints to a shard."""
    texts = durable(prints.where("n > 0").groupBy(F.col("text_key").alias("key")).agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2")), "text-fingerprints")
    nodes = durable(texts.groupBy("fp").agg(F.min(F.struct("key", "fp2")).alias("m")).select("fp", F.col("m.key").alias("lead"), F.col("m.fp2").alias("fp2")), "fingerprint-leads")
    bits = min(40, max(10, nodes.count().bit_length() - 4))
    links = shard_links(nodes, radius, sampled_routes(routes, bits), of_shard=_nearest, again=_dealt_finer)
    lead = lambda fp, name: nodes.select(F.col("fp").alias(fp), F.col("lead").alias(name), F.col("fp2").alias(f"{name}2"))
    both = links.join(lead("a", "x"), "a").join(lead("b", "y"), "b")
    near = both.where(F.bit_count(F.col("x2").bitwiseXOR(F.col("y2"))) <= radius).select("x", "y")
    same = texts.select("key", "fp").join(nodes.select("fp", "lead"), "fp").where("key <> lead").select(F.col("lead").alias("x"), F.col("key").alias("y"))
    return near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, few: int = 16, most: int = 64, turns: int = 4, radius: int = 16, routes: int = 24, join: bool = True) -> tuple[DataFrame, DataFrame]:
    """(prints: doc_id, text_key of every row; texts: text_key, label, head): texts of one label
    are near-duplicates of each other, head is the least doc_id of a text.

    Texts that are equal but for white space and ASCII case are one node. Two nodes are
    linked where the Jaccard similarity of their sets of distinct shingles (as 64-bit hashes)
    reaches `similarity`, and groups are the components of all such links. First the pairs
    that SimHash fingerprints within `radius` bits bring are compared. Then those that the
    fingerprints have missed: two sets alike in t share a shingle among the first n - ceil(t n) + 1 of each in any one
    order; here common shingles come last. Up to `few` texts that share such a shingle
    are all compared. Of more, each is first compared with one of them, and then, as
    components are known, with those of other components: all at once if these pairs are
    at most `most` a text, else with one other text each turn and with all in the
    last of `turns`. Before their texts are read, pairs whose parities of hashes differ in
    more bits than alike sets differ in shingles are ruled out. So pairs within a
    component and pairs that cannot be alike are left out and no others. Without `join` only
    what the fingerprints bring is linked.
    """
    ratio = Fraction(similarity).limit_denominator(1000)
    num, den = ratio.numerator, ratio.denominator
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        often, levels = common.value
        for batch in batches:
            keys, sizes, prefixes, parities, prints, others = [], [], [], [], [], []
            for t in batch["text"].tolist():
                h = shingle_hashes(t, width)
                prints.append(signed(simhash(h)))
                others.append(signed(simhash(second(h))))
                h = np.unique(h)
                parities.append(parity(h))
                if len(often) and len(h):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    h = h[np.argsort(np.where(often[at] == h, levels[at], 0), kind="stable")]
                keys.append(text_key(t))
                sizes.append(len(h))
                prefixes.append(h[: len(h) + (-num * len(h)) // den + 1 if len(h) else 0].view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": np.array(keys, dtype=np.int64), "n": np.array(sizes, dtype=np.int64), "prefix": prefixes, "parity": parities, "fp": np.array(prints, dtype=np.int64), "fp2": np.array(others, dtype=np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = durable(docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text_key long, n long, prefix array<long>, parity binary, fp long, fp2 long"), "prefixes", batch_rows=TEXT_ROWS)
    near = durable(_fingerprint_pairs(prints, radius, routes), "fingerprint-pairs")
    links = _alike(docs, near, width, num, den)
    heads = prints.groupBy("text_key").agg(F.min("doc_id").alias("head"))
    named_texts = lambda found: durable(heads.join(found, F.col("text_key") == F.col("node"), "left").select("text_key", F.coalesce("label", "text_key").alias("label"), "head"), "texts")
    if not join:
        return prints.select("doc_id", "text_key"), named_texts(durable(components(links), "text-components"))
    # what the fingerprints have missed
    sets = prints.where("n > 0").groupBy(F.col("text_key").alias("key")).agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    single = sets.select("key", "n", F.posexplode("prefix").alias("at", "s")).select("s", "key", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
    made = durable(_candidates(single, num, den, few), "candidates")
    asked = durable(made.where("kind = 0").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "pairs")
    tried, links = near.unionByName(asked), links.unionByName(_alike(docs, asked, width, num, den))
    found = durable(components(links), "text-components")
    left = made.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("key"), F.col("c").alias("place"))
    if left.limit(1).count():
        # aggregated before the join: a text of many copies is a row a task
        parities = prints.where("n > 0").groupBy(F.col("text_key").alias("_key")).agg(F.first("parity").alias("parity"))
        left = durable(left.join(parities, F.col("key") == F.col("_key")).select("s", "key", "place", "parity"), "crowded-prefixes")
    for turn in range(1, turns + 1):
        if not left.limit(1).count():
            break
        named = left.join(found, F.col("key") == F.col("node"), "left").select("s", "key", "place", F.coalesce("label", "key").alias("label"), "parity")
        more = durable(_across(named, num, den, turn, most, turn == turns), "across")
        asked = durable(more.where("kind = 0").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if asked.limit(1).count():
            fresh = _alike(docs, asked, width, num, den)
            tried, links = tried.unionByName(asked), links.unionByName(fresh)
            if fresh.limit(1).count():
                found = durable(components(links), "text-components")
        left = left.join(more.where("kind = 1").select(F.col("a").alias("s")).distinct(), "s", "left_semi")
    return prints.select("doc_id", "text_key"), named_texts(found)


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, few: int = 16, most: int = 64, turns: int = 4) -> DataFrame:
    """Groups of near-duplicates: (doc_id, text_key, group: the least doc_id of the group, null if
    all its ids are; keep: whether doc_id is that)."""
    prints, texts = near_duplicate_texts(docs, width, similarity, few, most, turns)
    least = texts.groupBy(F.col("label").alias("_label")).agg(F.min("head").alias("group"))
    named = texts.join(least, F.col("label") == F.col("_label")).select(F.col("text_key").alias("_key"), "group")
    return prints.join(named, F.col("text_key") == F.col("_key")).select("doc_id", "text_key", "group", F.col("doc_id").eqNullSafe(F.col("group")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near-duplicates: one document of each group stays, whole: that of the
    least doc_id (null last), of several texts of this id the one of the least text key. Rows
    of one id whose texts are no near-duplicates all stay."""
    prints, texts = near_duplicate_texts(docs, width, similarity)
    first = F.struct(F.col("head").isNull().alias("none"), "head", "text_key")
    kept = durable(texts.groupBy("label").agg(F.min(first).alias("k")).select(F.col("k.head").alias("_kept"), F.col("k.text_key").alias("_key")), "kept-texts")
    keyed = docs.withColumn("_text_key", text_key_column(F.col("text")))
    out = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    twice = prints.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates(["doc_id", "_text_key"]) if twice else out).drop("_text_key")
