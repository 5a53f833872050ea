"""SimHash near-duplicate groups by deletion-variant signatures.

A text's fingerprint has 64 bits: each bit is the majority vote of that bit over the XXH64
hashes of all the text's word shingles. Two fingerprints link at ``max_distance`` or fewer
differing bits. With distance 3, two segments of 32 bits suffice: of two linked fingerprints
one segment differs by at most one bit. Each distinct fingerprint is indexed under every
one-wildcard variant of both segments, an equality shuffle brings the holders of a variant
together, and each candidate is verified on all 64 bits.

A variant that very many fingerprints share is split by the same rule: its members agree in all
but a bit of one segment, so they link where the rest differs by at most the distance, and are
dealt out by the one-wildcard variants of the rest's own segments. What shares both agrees in all
but 18 bits, which bounds the largest group whatever the data.

Inside one group no list of pairs is made: a breadth-first walk links each fingerprint once to
the group's tree, so the edges emitted are fewer than the members.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows
share a fingerprint and so a group. An empty table gives an empty result. The operator names
its own columns so as not to clash with the input's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import broadcast_if_small, drop, free_name, join_on, save, tune, utf8
from sluice.llm.components import components

#: XXH64's seed (fixed value).
SEED = 42
#: Fingerprints that may share a segment's variant before it is split.
HOT = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit majority fingerprint of a UTF-8 text, A-Z lower-cased; zero where there is no word."""
    words = text.lower().split()  # bytes: only A-Z fall, only ASCII white space splits
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n], ends[-n:]
    digest = xxhash.xxh64_intdigest
    votes, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, n, step):  # a block of shingles at a time, so that one huge text stays small
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(first[k : k + step].tolist(), last[k : k + step].tolist())], np.uint64)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, with a long column ``name`` holding the fingerprint's 64 bits."""
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    rest = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(text))
    schema = rest.drop(text).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in utf8(batch.column(batch.num_columns - 1))], np.uint64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*kept, name])

    return rest.mapInArrow(run, schema)


def variants(bits: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Every one-wildcard variant of every segment of each fingerprint: (keys, index of the fingerprint)."""
    width = 64 // parts
    low = _ALL >> np.uint64(64 - width)
    keys = np.empty((len(bits), parts * width), np.uint64)
    for part in range(parts):
        segment = (bits >> np.uint64(part * width)) & low
        for at in range(width):
            slot = part * width + at
            keys[:, slot] = (segment & ~(_ONE << np.uint64(at))) | (np.uint64(slot) << np.uint64(width))
    return keys.ravel(), np.repeat(np.arange(len(bits)), parts * width)


def tree(bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a forest that connects exactly what ``most`` or fewer differing bits connect.

    Each visited fingerprint is compared only with those not yet reached, so a dense group
    costs little more than its size.
    """
    edges, left = [], bits
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                reached = left[near]
                edges += [(at, x) for x in reached]
                queue += list(reached)
                left = left[~near]
    return edges


def _runs(batches):
    """Blocks of whole groups from rows sorted by key; a group may span batches."""
    held_k, held_b = [], []
    for batch in batches:
        k, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if held_k and (cut or held_k[-1][-1] != k[0]):
            yield np.concatenate([*held_k, k[:cut]]), np.concatenate([*held_b, b[:cut]])
            held_k, held_b = [], []
        elif cut:
            yield k[:cut], b[:cut]
        held_k.append(k[cut:])
        held_b.append(b[cut:])
    if held_k:
        yield np.concatenate(held_k), np.concatenate(held_b)


def split_variants(keys: np.ndarray, bits: np.ndarray, parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(finer key, index) of members of variants: each under every one-wildcard variant of the segments of its other bits.

    The other bits are cut into segments of which, at ``most`` differing bits, one differs by at most a bit.
    """
    width, cuts = 64 // parts, most // 2 + 1
    slot = keys >> np.uint64(width)
    first = (slot // np.uint64(width) + np.uint64(1)) * np.uint64(width)  # where the other bits begin, going round
    rest = np.where(first < 64, (bits >> (first % np.uint64(64))) | np.where(first < 64, bits << ((np.uint64(64) - first) % np.uint64(64)), np.uint64(0)), bits)
    edges = np.linspace(0, 64 - width, cuts + 1).astype(int).tolist()
    out = []
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        segment = (rest >> np.uint64(a)) & (_ALL >> np.uint64(64 - (b - a)))
        for at in range(b - a):
            tag = np.uint64(n * 64 + at + 1)
            fine = (segment & ~(_ONE << np.uint64(at))) * np.uint64(256) + tag
            mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ fine
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(mixed ^ (mixed >> np.uint64(32)))
    return np.stack(out, 1).ravel(), np.repeat(np.arange(len(keys)), len(out))


def links(bits: DataFrame, column: str, max_distance: int = 3, hot: int = HOT) -> DataFrame:
    """Tree edges (a, b) between distinct fingerprints at ``max_distance`` or fewer differing bits.

    ``bits`` holds each fingerprint once; give a saved frame. Segments: one more than half the
    distance, so that one of them differs by at most a bit. Variants that more than ``hot`` share are split.
    """
    parts = next(p for p in (1, 2, 4, 8) if max_distance // p <= 1)

    def index(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(own), 4096):
                keys, at = variants(own[k : k + 4096], parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[k : k + 4096][at].view(np.int64))], names=["key", "bits"])

    def verify(batches):
        for k, b in _runs(batches):
            change = np.flatnonzero(np.diff(k)) + 1
            starts, stops = np.concatenate(([0], change)), np.concatenate((change, [len(k)]))
            found = []
            size = stops - starts
            for s in starts[size == 2]:
                if np.bitwise_count(np.uint64(b[s : s + 1].view(np.uint64)[0] ^ b[s + 1 : s + 2].view(np.uint64)[0])) <= max_distance:
                    found.append((b[s], b[s + 1]))
            for s, e in zip(starts[size > 2], stops[size > 2]):
                found += [(np.uint64(x).view(np.int64), np.uint64(y).view(np.int64)) for x, y in tree(b[s:e].view(np.uint64), max_distance)]
            if found:
                a = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a.min(1)), pa.array(a.max(1))], names=["a", "b"])

    def split(batches):
        for batch in batches:
            keys, own = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for k in range(0, len(own), 4096):
                fine, at = split_variants(keys[k : k + 4096], own[k : k + 4096], parts, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), pa.array(own[k : k + 4096][at].view(np.int64))], names=["key", "bits"])

    one = bits.select(F.col(column).alias("bits"))
    keyed = one.mapInArrow(index, "key long, bits long")
    if parts > 1:  # at one segment a variant has two members
        crowded = _crowded(one, parts, hot)
        if not crowded.isEmpty():
            wide = broadcast_if_small(crowded)
            apart = keyed.join(wide.where("needed"), "key", "left_semi").mapInArrow(split, "key long, bits long")
            keyed = keyed.join(wide, "key", "left_anti").unionByName(apart)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def _crowded(one: DataFrame, parts: int, hot: int) -> DataFrame:
    """(key, needed) of the variants that may have more than ``hot`` members, found from counts of the segments' plain values.

    Members with the same value share all its variants, so the first stands for the others; those are
    needed only where the wildcard brings a second value in.
    """
    width = 64 // parts
    segment = lambda n: F.shiftrightunsigned("bits", n * width).bitwiseAND(F.lit((1 << width) - 1))
    values = one.select(F.posexplode(F.array(*[segment(n) for n in range(parts)])).alias("part", "value"))
    many = save(values.groupBy("part", "value").agg(F.count("*").alias("n")), "simhash-values")
    both = many.where(F.col("n") * 2 > hot)  # of a variant's two values one has over half of its members

    def variants_of(batches):
        for batch in batches:
            part, value = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(2))
            at = np.arange(width, dtype=np.uint64)[None, :]
            keys = (value[:, None] & ~(_ONE << at)) | (((part * np.uint64(width))[:, None] + at) << np.uint64(width))
            flipped = value[:, None] ^ (_ONE << at)
            columns = [np.repeat(part, width), flipped.ravel(), keys.ravel(), np.tile(at.ravel() == 0, len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=["part", "value", "key", "first"])

    found = save(both.select(F.col("part").cast("long").alias("part"), "value").mapInArrow(variants_of, "part long, value long, key long, first boolean"), "simhash-crowded")
    there = many.select(F.col("part").cast("long").alias("part"), "value").join(broadcast_if_small(found), ["part", "value"]).select("key").distinct()
    marked = found.select("key", "first").unionByName(there.select("key", F.lit(True).alias("first")))
    return save(marked.groupBy("key").agg(F.max("first").alias("needed")), "simhash-split")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """(id, text_hash, fingerprint, component_id, root), a row for each of ``docs``; all but the id are longs, ids keep their type.

    component_id is the smallest id reachable over links, the row's own included. Ids may be
    null or repeat; a component whose ids are all null has component_id null. Fingerprints that
    many rows share, and components of many fingerprints, are joined apart from the others.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    marked = save(fingerprints(own, "text", shingle), "simhash")
    distinct = save(marked.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    edges = save(links(distinct, "fingerprint", max_distance), "simhash-links")
    roots = save(components(edges), "simhash-roots")
    named = distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = save(named, "simhash-named")
    least = save(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = save(join_on(named, least, "root").select("fingerprint", "component_id", "root"), "simhash-components")
    drop(edges, roots, least)
    return join_on(marked, named, "fingerprint", distinct.select("fingerprint", "n")).select("id", "text_hash", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that are first of their near-duplicate group, all columns kept.

    First means smallest id, null last; where rows of a group repeat that id, smallest hash of
    the text; of rows equal in both, one stays.
    """
    return first_rows(docs, groups(docs, id_col, text, shingle, max_distance), id_col, text)


def first_rows(docs: DataFrame, grouped: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are first of their group in ``grouped`` (id, text_hash, root), as ``keep_one`` defines it."""
    k, h = free_name(docs, "row_key"), free_name(docs, "row_hash")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"))
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    chosen = first.select(named(F.col("first.id")).alias(k), F.col("first.text_hash").alias(h))
    rest = docs.withColumns({k: named(F.col(f"`{id_col}`")), h: F.xxhash64(F.col(f"`{text}`"))})
    return rest.join(chosen, [k, h], "left_semi").dropDuplicates([k, h]).drop(k, h)


def hex_bits(column) -> F.Column:
    """16 lowercase hex digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
