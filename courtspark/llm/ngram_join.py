"""Exact n-gram Jaccard self-join: universe partition, pigeonhole, one-deletion neighbourhoods.

A document is the set of its distinct runs of ``n`` words. Two sets of sizes s and t with Jaccard
similarity of at least p/100 differ in at most (s + t)(100 - p)/(100 + p) tokens. Tokens are hashed
into m segments; m belongs to a *size band* (sizes from 2^b to 2^(b+1)). Differences fall into
segments, so of more than that many non-empty segments at least one must be equal: this segment's
content is an index key.

*Cost-based allocation.* Every document uses only as many keys as the pigeonhole needs, the
cheapest ones: first segments with a rare token, then those with more tokens. The order depends on
the content alone, so equal segments are equally cheap for both documents, and whichever of the two
goes less far down its list, the other one has gone at least as far: no pair is lost. Documents with
too few non-empty segments also use *one-deletion neighbourhoods*: segments without one of their
tokens, for the first segments in order; equal or one token apart then both meet. If even these are
too few, the document joins one last key of its band.

Tokens that are common in the corpus are counted over all documents; only those above a fixed share
of all tokens are kept, so their number is bounded. They only order the keys.

*Links to components.* Documents with equal sets are one node, and only one of them makes keys. In each of
a few rounds every node of a key's group is compared with the
best connected node of one of the group's components, the node whose keys have the most sets: in a family of near copies that
is the one that was changed least, to which the others are closest. Links form components, so that
families fall together. What is left is every pair of nodes of a group that are not yet in
one component. Their *parities* rule out most of them: bit i of a set's
parity says whether an odd number of its tokens falls on i, so two parities differ in no more bits
than the sets in tokens. The rest is compared exactly, by intersecting the whole token sets. Groups of common keys are dealt out by node, so that no key fills a task.

Defined cases: a null, empty or wordless text has size 0 and is linked with nothing; repeated rows
are copies of each other; ``component_id`` of rows without any ``doc_id`` in reach is null. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtspark.llm.common import row_hash, small_batches, stage
from courtspark.llm.components import components

WORDS = 5
PERCENT = 80
#: Mean tokens of a segment for the largest set of a band.
LOAD = 2.5
#: A token counts as common above this share of all tokens: at most 1 / COMMON tokens are kept.
COMMON = 1e-6
#: Keys that are taken into memory together.
KEYS_PER_GROUP, LEAST_GROUPS = 1_000_000, 64
#: Groups of keys made of common tokens only are split into so many parts.
SPLIT = 16
#: Rounds in which every node of a key meets the best connected node of a component before the exact pairs.
ROUNDS = 2
#: Bits of the filter that finds the texts to read again; a full filter only lets more pass.
FILTER_BITS = 1 << 26
#: Nodes, of 16 bytes each, whose list may be sent to all tasks; a longer one is joined.
LISTED = 1_000_000
#: Largest parity of a set; for larger sets it only rules out less.
PARITY_BITS = 8192
_FLUSH = 2_000_000
_CACHE = 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    """64-bit hashes of words, emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: _Words, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; of all words when there are fewer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):  # a sum of word hashes with another odd factor for each place
        h *= _A
        h += w[j : len(w) - k + 1 + j]
    h = _mix(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def signature(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], np.uint64).view(np.int64)[0])


def _needed(size: int, percent: int) -> int:
    """One more than the tokens in which the set and any set similar to it can differ."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent) + 1


def _key(base: np.ndarray, total: np.ndarray, count: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Hash of a segment and its content; the lowest bit is set when it holds no rare token."""
    k = _mix(base ^ _mix(total + count.astype(np.uint64) * _B))
    return (k & ~np.uint64(1)) | (rare == 0).astype(np.uint64)


def segment_keys(tokens: np.ndarray, common: np.ndarray, percent: int = PERCENT, load: float = LOAD) -> np.ndarray:
    """Index keys of a set. Keys of common tokens only have their lowest bit set."""
    size = len(tokens)
    if not size:
        return tokens
    band, need, out = size.bit_length() - 1, _needed(size, percent), []
    is_common = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens if len(common) else np.zeros(size, bool)
    parts = _mix(tokens ^ _C)
    for b in range(band, (size * 100 // percent).bit_length()):
        m = max(1, int(np.ceil((2 << b) / load)))
        seg = (_mix(tokens * _A + np.uint64(b + 1)) % np.uint64(m)).astype(np.uint16 if m <= 1 << 16 else np.uint64)
        order = np.argsort(seg, kind="stable")  # short numbers are sorted by radix
        seg, part, usual = seg[order].astype(np.uint64), parts[order], is_common[order]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        count = np.diff(np.r_[first, size])
        total, rare = np.add.reduceat(part, first), np.add.reduceat((~usual).astype(np.int64), first)
        base = _mix(seg[first] * _A + np.uint64(b + 1))

        full = _key(base, total, count, rare)
        if len(first) >= need:
            out.append(full[np.lexsort((full, -count, rare == 0))[:need]])
            continue
        out.append(full)
        upto = min(need - len(first), len(first))  # segments that are also matched with one token more or less
        reach = int(seg[first[upto - 1]]) + 1 if upto == need - len(first) else m
        own = np.repeat(np.arange(len(first)), count)
        near = own < upto
        own = own[near]
        out.append(_key(base[own], total[own] - part[near], count[own] - 1, rare[own] - ~usual[near]))
        empty = np.setdiff1d(np.arange(reach, dtype=np.uint64), seg[first])
        none = np.zeros(len(empty), np.uint64)
        out.append(_key(_mix(empty * _A + np.uint64(b + 1)), none, none, none))
        if 2 * len(first) < need:
            out.append(_mix(np.array([b + 1], np.uint64)) | np.uint64(1))
    return np.unique(np.concatenate(out))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sizes(n: int):
    """Documents: doc_id, row_hash, sig, n. Often repeated tokens: token, times."""

    def run(batches):
        words, held, waiting = _Words(), [], 0

        def often():
            nonlocal held, waiting
            tokens, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            keep = times >= 4
            held, waiting = [], 0
            tokens, times = tokens[keep].view(np.int64), times[keep]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(tokens), pa.array(times.astype(np.int64))], schema=schema)

        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "row_hash", "sig", "n", "token", "times")])
        for batch in batches:
            sigs, sizes = [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), words, n)
                sigs.append(signature(tokens))
                sizes.append(len(tokens))
                held.append(tokens)
                waiting += len(tokens)
                if waiting > _FLUSH:
                    yield often()
            none = pa.nulls(len(sigs), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row_hash"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), none, none], schema=schema)
        yield often()

    return run


def _picked(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Array:
    """Texts of the rows that are in a filter."""
    at = np.asarray(batch.column("at"))
    return batch.column("text").take(pa.array(np.flatnonzero((bits[at // 64] >> (at % 64)) & 1)))


def _keys(bits: np.ndarray, common: np.ndarray, groups: int, n: int, percent: int, load: float):
    """part, sig, n, keys (bytes): the keys of a document in the filter that go to one part."""

    def run(batches):
        words = _Words()
        for batch in batches:
            parts, sigs, sizes, blobs = [], [], [], []
            for text in _picked(batch, bits):
                tokens = shingles(text.as_py(), words, n)
                if not len(tokens):
                    continue
                sig, keys = signature(tokens), segment_keys(tokens, common, percent, load)
                salt = np.where(keys & np.uint64(1), np.uint64(xxhash.xxh3_64_intdigest(sig.to_bytes(8, "big", signed=True)) % SPLIT), np.uint64(0))
                part = _mix(keys + salt * _A) % np.uint64(groups)
                order = np.argsort(part, kind="stable")
                part, keys = part[order], keys[order]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for a, b in zip(first, np.r_[first[1:], len(part)], strict=True):
                    parts.append(int(part[a]))
                    sigs.append(sig)
                    sizes.append(len(tokens))
                    blobs.append(keys[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "sig", "n", "keys"])

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """Rows of keys that at least two different sets have; keys that may go on in other parts keep their
    single rows too."""
    blobs = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    reps = np.array([len(b) // 8 for b in blobs])
    sig, size = (np.repeat(np.asarray(table.column(c), np.int64), reps) for c in ("sig", "n"))
    order = np.lexsort((size, sig, keys))
    keys, sig, size = keys[order], sig[order], size[order]
    if len(keys):
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (sig[1:] != sig[:-1]) | (size[1:] != size[:-1])]
        keys, sig, size = keys[fresh], sig[fresh], size[fresh]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[first, len(keys)])
        split = (keys[first] & np.uint64(1)).astype(bool)
        # of keys that the same sets have, one is enough
        who = np.bitwise_xor.reduceat(_mix(_mix(sig.view(np.uint64)) + size.astype(np.uint64)), first)
        _, one = np.unique(who ^ _mix(count.astype(np.uint64)), return_index=True)
        once = np.zeros(len(first), bool)
        once[one] = True
        keep = np.repeat(((count > 1) & once) | split, count)
        keys, sig, size = keys[keep], sig[keep], size[keep]
    return pa.table({"key": keys.view(np.int64), "sig": sig.astype(np.int64), "n": size.astype(np.int64)})


def _node(sig: str, n: str):
    return F.struct(F.col(sig).alias("sig"), F.col(n).alias("n"))


def _marks_fit(percent: int) -> Column:
    """The parities of a and b differ in no more bits than similar sets can."""
    more = "if(size(x.mark) > size(y.mark), x.half, x.mark)", "if(size(y.mark) > size(x.mark), y.half, y.mark)"
    apart = f"aggregate(zip_with({more[0]}, {more[1]}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return F.expr(f"({apart}) * {100 + percent} <= (x.node.n + y.node.n) * {100 - percent}")


def _bits(reps: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size over the rows of ``reps``."""
    at = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(bits))
    words = reps.select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toPandas()  # at most bits / 64 rows
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of tokens falls on i. Every token in which two sets differ
    flips one bit, so their parities differ in no more bits than the sets in tokens."""
    bits = min(max(64, 2 << len(tokens).bit_length()), PARITY_BITS)
    odd = np.bincount((_mix(tokens ^ _B) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(bits: np.ndarray, n: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            got = [shingles(t.as_py(), words, n) for t in _picked(batch, bits)]
            marks = [parity(t) for t in got]
            halves = [m[: len(m) // 2] ^ m[len(m) // 2 :] if len(m) > 1 else m for m in marks]
            columns = [pa.array([signature(t) for t in got], pa.int64()), pa.array([len(t) for t in got], pa.int64()), pa.array([t.tobytes() for t in got], pa.binary())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (marks, halves)]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "n", "tokens", "mark", "half"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = [similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    s = sets.select(_node("sig", "n").alias("node"), "tokens")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    # few nodes are looked at in a round: a small list of them keeps the others' tokens out of the shuffle
    s = s.join(F.broadcast(wanted) if wanted.count() <= LISTED else wanted, "node", "left_semi")
    rows = pairs.join(s.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    rows = rows.join(s.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    kind = "a struct<sig:bigint,n:bigint>, b struct<sig:bigint,n:bigint>"
    return stage(rows.mapInArrow(_verify(percent), kind), "links")


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of what is already known and of new links."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if comp is not None:
        edges = edges.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return stage(components(edges), "components")


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = WORDS,
    percent: int = PERCENT,
    load: float = LOAD,
) -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, component_id. ``percent`` is 50 at least, as parities
    of sets that differ more in size are not compared."""
    if percent < 50:
        raise ValueError(f"percent is {percent}, at least 50 is needed")
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row_hash", row_hash(F.col("text")))
    six = "doc_id long, row_hash long, sig long, n long, token long, times long"
    first = stage(texts.mapInArrow(_sizes(n), six), "sizes")
    sized = first.where("token IS NULL").select("doc_id", "row_hash", "sig", "n")
    total = sized.agg(F.sum("n")).first()[0] or 0
    often = first.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= max(4.0, COMMON * total))
    common = np.sort(np.array([r[0] for r in often.select("token").collect()], np.int64).view(np.uint64))  # at most 1 / COMMON

    # equal sets are one node, and one of its rows makes the keys
    nodes = sized.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row_hash")).alias("rep"))
    nodes = stage(nodes.select(_node("sig", "n").alias("node"), "least", "rep.doc_id", "rep.row_hash"), "nodes")
    at = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(FILTER_BITS))
    placed = texts.select(at.alias("at"), "text")
    groups = max(LEAST_GROUPS, -(-total * 2 // 5 // KEYS_PER_GROUP))
    keyed = placed.mapInArrow(_keys(_bits(nodes, FILTER_BITS), common, groups, n, percent, load), "part long, sig long, n long, keys binary")
    met = keyed.groupBy("part").applyInArrow(_meetings, "key long, sig long, n long")
    met = stage(met.select("key", _node("sig", "n").alias("node")), "met")

    # keys of one set are dropped, and all but one of the keys that the same sets have
    who = [F.count("*").alias("sets"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("who_else")]
    shared = met.groupBy("key").agg(*who).where("sets > 1").groupBy("sets", "who", "who_else").agg(F.min("key").alias("key")).select("key", "sets")
    met = stage(met.join(shared, "key").select("key", "node", "sets"), "met")
    wanted = met.select("node").distinct().join(nodes, "node").select("doc_id", "row_hash")
    sets = placed.mapInArrow(_sets(_bits(wanted, FILTER_BITS), n), "sig long, n long, tokens binary, mark array<bigint>, half array<bigint>")
    sets = stage(sets.dropDuplicates(["sig", "n"]), "sets")

    # how well a node is connected: the sets of all its keys
    scores = stage(met.groupBy("node").agg(F.sum("sets").alias("score")), "scores")
    marks = stage(sets.select(_node("sig", "n").alias("node"), "mark", "half"), "marks")
    comp, sizes_fit = None, f"{percent} * greatest(x.node.n, y.node.n) <= 100 * least(x.node.n, y.node.n)"
    for place in (*range(1, ROUNDS + 1), None):
        if comp is None:
            left = met.select("key", "node", F.col("node").alias("component"))
        else:
            left = met.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
            mixed = left.groupBy("key").agg((F.min("component") != F.max("component")).alias("more")).where("more").select("key")
            left = left.join(mixed, "key")
        if place:
            left = stage(left.join(scores, "node"), "left")
            best, p = F.struct("score", "node"), F.struct("node", "component")
            if place == 1:  # every node of a key meets its best connected one,
                other = left.groupBy("key").agg(F.max_by(p, best).alias("p")).select("key", "p.*")
            else:  # and in later rounds that of another component
                tops = left.groupBy("key", "component").agg(F.max(best).alias("best"), F.max_by(p, best).alias("p"))
                ranked = tops.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("best"))))
                other = ranked.where(F.col("place") == place).select("key", "p.*")
            cross = left.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & F.expr(sizes_fit))
            # a pair that meets under many keys is looked at once, so parities go along with pairs, not with keys
            pairs = stage(cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
            x, y = (F.struct("node", "mark", "half").alias(c) for c in "xy")
            pairs = pairs.join(marks.select(F.col("node").alias("a"), x), "a").join(marks.select(F.col("node").alias("b"), y), "b").where(_marks_fit(percent))
            pairs = pairs.select("a", "b")
        else:  # at last every pair of a key that is not yet in one component
            left = stage(left.join(marks, "node").select("key", "node", "component", "mark", "half"), "left")
            apart = F.col("x.component") < F.col("y.component")
            cross = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & F.expr(sizes_fit) & _marks_fit(percent))
            pairs = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        comp = _merged(comp, _linked(stage(pairs, "pairs"), sets, percent))
    named = nodes.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = stage(named, "named")
    small = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.join(small, "component").select("node.sig", "node.n", "component_id"), "named")
    s, c = sized.alias("s"), named.alias("c")
    out = s.join(c, (F.col("s.sig") == F.col("c.sig")) & (F.col("s.n") == F.col("c.n")), "left")
    return out.select(
        F.col("s.doc_id").alias("doc_id"),
        F.col("s.row_hash").alias("row_hash"),
        F.col("s.n").alias("n_shingles"),
        F.when(F.col("s.n") > 0, F.col("component_id")).otherwise(F.col("s.doc_id")).alias("component_id"),
    )
