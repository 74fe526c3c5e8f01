"""Exact Jaccard join of documents on word shingles, with set relations used to skip work.

1. A set can only link if at least the threshold's share of its shingles occurs elsewhere, so at most
   the rest of any part of it does not.  The half of all shingles with the smaller hashes is looked up
   (``shared``); sets that lack more of theirs than any link allows are settled at once.
2. Equal sets become one representative.  Sets that agree in a min-hash compare with the most central
   of them (whose shingles are the most common), one comparison each; a set that links to it
   joins its cluster and takes over its answers, so a cluster never compares within itself.
3. The rest is a prefix index, rarest shingles first by exact counts, without those of one set.  Its
   lists are blocks of equal cluster, set size, shared size and position; blocks of one component, and
   those whose sizes and positions leave too little in common, are skipped as a whole.  What is left names
   pairs of clusters, and only their centres are compared.
4. From the centres' distance and the radii the triangle inequality answers for all members, or
   leaves those that a member pair could still link, which are compared exactly.

Only connections are returned: of sets that are connected through a centre, further links are implied
and not listed.  Sets are 64-bit hashes of shingles.

Nulls: a null or empty text, or one without words, has no shingles and links with nothing; a null
id links with nothing and its component is null.  Rows that repeat an id are one node with the
links of all of them.  Texts of any length count whole; an empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldform.llm.bytesets import mix, shingle_sets
from fieldform.llm.common import components
from fieldform.llm.shared import CHUNK, COUNT_SENT, SENT, chunk_ids, counted_tokens, ranges_and_bits, send, send_counts, shared_owners
from fieldform.scale import materialize

WIDTH, PERCENT = 5, 75
#: Bits of the map of wanted documents, in blocks: 4 MB whatever the corpus.
MAP_BITS, MAP_BLOCK = 25, 19
LEADER_KEYS = 4
NO_ID = -(1 << 63)
EPS = 1e-9

PROFILE = "doc_id long, n_shingles long, probed long, shared long, low long, high long"
#: Tokens are in the order of the index: those of this set alone (``alone`` of them), then the rarest first.
SETS = "doc_id long, n int, alone int, central double, tokens binary"


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of ``n`` that a linked set must hold."""
    return -(-n * percent // 100)


def _send_sets(ranges: int, bits: int, width: int):
    def run(batches):
        names, held, ids, sizes, marks, count = chunk_ids(), [], [], [], [], 0

        def flush():
            tokens, n = np.concatenate(held), np.concatenate(sizes)
            owner, probe = np.repeat(np.arange(len(n), dtype=np.uint32), n), tokens >> np.uint64(63) == 0
            tokens, owner = tokens[probe], owner[probe]
            about = np.stack([np.concatenate(ids), n, np.bincount(owner, minlength=len(n)), *np.concatenate(marks, axis=1)])
            # All probed hashes have a leading zero, which the ranges need not see.
            return send(next(names), tokens << np.uint64(1), owner, about.astype(np.int64).tobytes(), ranges, bits)

        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            for first, last, tokens, n in shingle_sets(batch.column(1), width):
                mark = np.zeros((2, len(n)), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    mark[0, full] = np.add.reduceat(mix(tokens), at)
                    mark[1, full] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
                held.append(tokens)
                ids.append(keys[first:last])
                sizes.append(n)
                marks.append(mark.view(np.int64))
                count += len(tokens)
                if count >= CHUNK:
                    yield flush()
                    held, ids, sizes, marks, count = [], [], [], [], 0
        if sizes:
            yield flush()

    return run


def _profile(about: bytes, owners: np.ndarray) -> pa.Table:
    ids, n, probed, low, high = np.frombuffer(about, np.int64).reshape(5, -1)
    shared = np.bincount(owners, minlength=len(ids))
    return pa.table({"doc_id": ids, "n_shingles": n, "probed": probed, "shared": shared.astype(np.int64), "low": low, "high": high})


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _bits(batches):
    for batch in batches:
        bit = _bit(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(bit >> MAP_BLOCK, pa.int32()), pa.array(bit & ((1 << MAP_BLOCK) - 1), pa.int32())], names=["block", "bit"])


def _block(group: pa.Table) -> pa.Table:
    flags = np.zeros(1 << MAP_BLOCK, bool)
    flags[group.column("bit").to_numpy()] = True
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})


def document_map(ids: DataFrame) -> np.ndarray:
    """A bit map of hashed ids, of a fixed size.  It may let others through, whose sets then are looked at in vain."""
    bits = ids.mapInArrow(_bits, "block int, bit int").distinct()
    out = np.zeros((1 << (MAP_BITS - MAP_BLOCK), 1 << (MAP_BLOCK - 3)), np.uint8)
    for row in bits.groupBy("block").applyInArrow(_block, "block int, flags binary").collect():
        out[row["block"]] = np.frombuffer(row["flags"], np.uint8)
    return np.unpackbits(out.ravel()).view(bool)


def _send_counts(wanted, ranges: int, bits: int, width: int):
    def run(batches):
        here, names, ids, held, sizes, count = wanted.value, chunk_ids(), [], [], [], 0

        def flush():
            n = np.concatenate(sizes)
            about = np.concatenate([np.array([len(n)]), np.concatenate(ids), n]).astype(np.int64).tobytes()
            tokens = np.concatenate(held)
            return send_counts(next(names), tokens, about + tokens.tobytes(), ranges, bits)

        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            rows = np.flatnonzero(here[_bit(keys)] & (keys != NO_ID))
            if len(rows) == 0:
                continue
            batch, keys = batch.take(pa.array(rows)), keys[rows]
            for first, last, tokens, n in shingle_sets(batch.column(1), width):
                full = n > 0
                ids.append(keys[first:last][full])
                sizes.append(n[full])
                held.append(tokens)
                count += len(tokens)
                if count >= CHUNK:
                    yield flush()
                    ids, held, sizes, count = [], [], [], 0
        if count:
            yield flush()

    return run


def _order_sets(bits: int):
    def run(about: bytes, owners: np.ndarray, levels: np.ndarray) -> pa.Table:
        """The sets of a chunk with their tokens from rare to common."""
        count = int(np.frombuffer(about[:8], np.int64)[0])
        ids, n = np.frombuffer(about[8 : 8 + 16 * count], np.int64).reshape(2, -1)
        tokens = np.frombuffer(about[8 + 16 * count :], np.uint64)
        # A level is that of a key; every token of the key has it, in this chunk as in any other.
        _, first, back = np.unique(tokens >> np.uint64(64 - bits), return_index=True, return_inverse=True)
        at_first = np.zeros(len(tokens), np.uint8)
        at_first[owners] = levels
        level = at_first[first][back]
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((tokens, level, row))
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]).tolist()
        raw = memoryview(tokens[order].tobytes())
        lists = [bytes(raw[8 * a : 8 * b]) for a, b in zip(edges, edges[1:], strict=False)]
        alone = np.bincount(row[level == 0], minlength=len(n))
        central = np.bincount(row, level, minlength=len(n)) / n
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int32()), "alone": pa.array(alone, pa.int32()),
            "central": pa.array(central, pa.float64()), "tokens": pa.array(lists, pa.binary()),
        })

    return run


def _tokens(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _leader_keys(batches):
    """Min-hashes of each set, of its shingles that other sets have as well."""
    salts = mix(np.arange(1, LEADER_KEYS + 1, dtype=np.uint64))
    for batch in batches:
        out = [[], [], [], []]
        for doc_id, alone, central, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), _tokens(batch.column(3)), strict=True):
            if alone == len(tokens):
                continue
            for k, salt in enumerate(salts):
                for column, value in zip(out, (doc_id, k, int(mix(tokens[alone:] ^ salt).min().view(np.int64)), central), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "place", "key", "central"])


ENTRIES = "token long, doc_id long, n int, common int, place int, lead long, part long, far double"


def _entries(percent: int):
    """Index entries of the prefix of each set, without the shingles of this set alone."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], [], [], []]
            ids, alones, leads, parts, fars = (batch.column(k).to_pylist() for k in range(5))
            for doc_id, alone, lead, part, far, tokens in zip(ids, alones, leads, parts, fars, _tokens(batch.column(5)), strict=True):
                n = len(tokens)
                place = np.arange(n - int(_needed(np.int64(n), percent)) + 1 - alone)
                if len(place):
                    own = (tokens[alone : alone + len(place)].view(np.int64), doc_id, n, n - alone, place, lead, part, far)
                    for column, value in zip(out, own, strict=True):
                        column.append(value if isinstance(value, np.ndarray) else np.full(len(place), value))
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                arrays = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ENTRIES.split(", ")])

    return run


def _compare(batches):
    for batch in batches:
        common = [
            len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            for a, b in zip(_tokens(batch.column(2)), _tokens(batch.column(3)), strict=True)
        ]
        size = [np.array([len(x.as_py()) // 8 for x in batch.column(k)], np.int64) for k in (2, 3)]
        union = size[0] + size[1] - np.array(common, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "total"]
        )


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact overlap of each pair ``(a, b)``: ``common``, ``total``, ``linked`` and the Jaccard distance ``far``."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_tokens", "b_tokens")
    out = both.mapInArrow(_compare, "a long, b long, common long, total long")
    linked = F.col("common") * 100 >= F.col("total") * percent
    return out.select("*", linked.alias("linked"), (1 - F.col("common") / F.col("total")).alias("far"))


def _overlap_possible(percent: int):
    """Bounds by size and position if the shared shingle is the first that two sets have in common.

    All that they share then comes from it on, so enough must be left behind it in either.  A pair of sets that
    links meets at its first common shingle; the meetings at later ones need not be seen.
    """
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    behind = F.least(F.col("a.common") - F.col("a.place"), F.col("b.common") - F.col("b.place"))
    return (small * 100 >= large * percent) & (behind * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id that links lead to.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranges, bits = ranges_and_bits(slim, "text", 0.1)
    profile = materialize(shared_owners(slim.mapInArrow(_send_sets(ranges, bits, width), SENT), _profile, PROFILE), "profile")

    # Of the probed shingles of a linked set, at most the rest of the set is found nowhere else.
    n = F.col("n_shingles")
    alive = profile.where((n > 0) & ((F.col("probed") - F.col("shared")) * 100 <= n * (100 - percent)) & (F.col("doc_id") != NO_ID))
    # Equal sets are one: the smallest id stands for them.
    equal = ["low", "high", "n_shingles"]
    heads = materialize(alive.groupBy(*equal).agg(F.min("doc_id").alias("head")), "heads")
    wanted = spark.sparkContext.broadcast(document_map(heads.select("head")))
    heads = materialize(alive.join(heads, equal).select("doc_id", "head").distinct(), "heads")
    sent = slim.mapInArrow(_send_counts(wanted, ranges, bits, width), COUNT_SENT)
    sets = materialize(counted_tokens(sent, _order_sets(bits), SETS), "sets")

    # Clusters: one comparison per set and min-hash, with the most central set that shares it.
    keys = sets.select("doc_id", "alone", "central", "tokens").mapInArrow(_leader_keys, "doc_id long, place int, key long, central double")
    keys = materialize(keys, "keys")
    central = F.struct((-F.col("central")).alias("rank"), F.col("doc_id"))
    centres = materialize(keys.groupBy("place", "key").agg(F.min(central).alias("centre"), F.count("*").alias("held")).where("held > 1"), "centres")
    stars = keys.join(centres, ["place", "key"]).where("doc_id <> centre.doc_id").select(F.col("doc_id").alias("a"), F.col("centre.doc_id").alias("b")).distinct()
    stars = materialize(compare(stars, sets, percent).where("linked").select("a", "b", "far"), "stars")
    found = components(stars)
    leads = stars.select(F.col("b").alias("a")).distinct()
    joined = stars.join(leads, "a", "left_anti").groupBy("a").agg(F.min(F.struct("far", "b")).alias("best"))
    joined = joined.select(F.col("a").alias("doc_id"), F.col("best.b").alias("lead"), F.col("best.far").alias("far"))
    parts = found.select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    placed = sets.join(joined, "doc_id", "left").join(parts, "doc_id", "left").select(
        "doc_id", "alone", F.coalesce("lead", "doc_id").alias("lead"), F.coalesce("part", "doc_id").alias("part"),
        F.coalesce("far", F.lit(0.0)).alias("far"), "tokens",
    )
    index = materialize(placed.mapInArrow(_entries(percent), ENTRIES), "index")

    # Lists of more than one component, in blocks; blocks are skipped by size and position.
    several = index.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("token")
    index = materialize(index.join(materialize(several, "tokens"), "token", "left_semi"), "index")
    blocks = materialize(index.groupBy("token", "lead", "part", "n", "common", "place").agg(F.max("far").alias("far")), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = (F.col("a.lead") < F.col("b.lead")) & (F.col("a.part") != F.col("b.part"))
    meet = (F.col("a.token") == F.col("b.token")) & apart & _overlap_possible(percent)
    block = ("lead", "part", "n", "common", "place", "far")
    met = a.join(b, meet).select(F.col("a.token").alias("token"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in block])
    met = materialize(met, "met")
    rivals = met.groupBy(F.col("a_lead").alias("a"), F.col("b_lead").alias("b")).agg(F.max(F.col("a_far") + F.col("b_far")).alias("reach"))
    rivals = materialize(rivals, "rivals")
    measured = compare(rivals, sets, percent).select("a", "b", "linked", "far").join(rivals, ["a", "b"])
    measured = materialize(measured, "measured")
    links = stars.select("a", "b").union(measured.where("linked").select("a", "b"))
    found = components(links)

    # Members of clusters that are not connected yet and lie within reach of each other.
    limit = 1 - percent / 100 + EPS
    open_pairs = measured.where(~F.col("linked") & (F.col("far") <= limit + F.col("reach"))).select("a", "b", F.col("far").alias("between"))
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    open_pairs = open_pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    open_pairs = open_pairs.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b", "between")
    open_pairs = materialize(open_pairs, "open")
    # Only the blocks that met are unfolded to their members.
    near = met.join(open_pairs, (F.col("a_lead") == open_pairs["a"]) & (F.col("b_lead") == open_pairs["b"]))
    near = materialize(near.where(F.col("between") <= limit + F.col("a_far") + F.col("b_far")), "near")

    def members(side: str) -> DataFrame:
        held = [F.col(c).alias(f"{side}_{c}") for c in block[:-1]]
        return index.select("token", *held, F.col("doc_id").alias(f"{side}_id"), F.col("far").alias(f"{side}_own"))

    for side in "ab":
        near = near.join(members(side), ["token", *[f"{side}_{c}" for c in block[:-1]]])
    sides = near.where(F.col("between") <= limit + F.col("a_own") + F.col("b_own"))
    sides = sides.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    more = materialize(compare(sides, sets, percent).where("linked").select("a", "b"), "more")
    if more.take(1):
        found = components(links.union(more))

    named = heads.join(found.select(F.col("node").alias("head"), "component"), "head", "left")
    named = named.select("doc_id", F.coalesce("component", "head").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return profile.join(named, "doc_id", "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_shingles",
        F.when(F.col("doc_id") != NO_ID, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
