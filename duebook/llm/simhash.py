"""SimHash near-duplicates: fingerprints, and exact pairs within a few bits by
vantage-point trees.

A tree over a bounded sample of fingerprints deals all of them out to shards: at each
node the ones within the radius of the vantage point go inside, the others outside.
By the triangle inequality a fingerprint inside can only be linked to one outside if
it lies within the link distance of the border, so only those cross over, as guests
that are compared with a shard's members but belong to another shard. Within a shard a
tree over its own members does the same, down to leaves that are compared whole. A
shard answers with linked pairs that suffice to join its groups, fewer than it has
fingerprints, never with all pairs, and the groups are joined by ``common.components``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import components, give_back, materialise, text_bytes, unused

SHINGLE = 3
BITS = 3
SEED = 42
SHARD = 8192            # fingerprints a shard is planned for
LEAF = 1024             # fingerprints that are compared whole
PER_SHARD = 256         # sampled fingerprints for each shard of the tree
SAMPLE = 2 ** 18        # and at most so many
BLOCK = 65536           # shingles counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return int.from_bytes(digest(line, SEED), "big")
    cuts = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = b"".join([digest(line[a:b - 1], SEED) for a, b in zip(
            cuts[at:min(at + BLOCK, n)], cuts[at + shingle:])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(
            0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                ["doc_id", "text_key", "fingerprint"])
        give_back()

    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


# ------------------------------------------------------------------- trees --
def grow(points: np.ndarray, leaves: int, bits: int = BITS) -> list[tuple]:
    """A vantage-point tree as a list of nodes (vantage, radius, inner, outer); a
    child below zero is leaf -child - 1. Of twelve vantage points the one with the
    thinnest border is taken. Points that no vantage point parts stay in one leaf."""
    nodes: list[tuple] = []
    made = 0

    def leaf():
        nonlocal made
        made += 1
        return -made

    todo = [(points, leaves, None, 0)]
    root = None
    while todo:
        here, want, parent, side = todo.pop()
        best = None
        if want > 1 and len(here) > 1:
            inside = want // 2
            for vantage in here[::max(1, len(here) // 12)][:12]:
                far = np.bitwise_count(here ^ vantage)
                order = np.sort(far)
                radius = int(order[max(0, len(here) * inside // want - 1)])
                if radius == order[-1]:
                    radius -= 1
                near = far <= radius
                if radius < 0 or not near.any() or near.all():
                    continue
                border = (near & (far > radius - bits)).mean()
                if best is None or border < best[0]:
                    best = (border, vantage, radius, near)
        if best is None:
            name = leaf()
        else:
            name = len(nodes)
            _, vantage, radius, near = best
            nodes.append([vantage, radius, None, None])
            todo.append((here[near], inside, name, 2))
            todo.append((here[~near], want - inside, name, 3))
        if parent is None:
            root = name
        else:
            nodes[parent][side] = name
    return [tuple(n) for n in nodes] if root is not None and root >= 0 else []


def dealt(tree: list[tuple], points: np.ndarray, own: np.ndarray, guests: np.ndarray,
          bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, members, guests) as indexes of `points`. Every pair within `bits` meets
    in just the leaf of one of the two."""
    todo = [(0 if tree else -1, own, guests)]
    while todo:
        name, own, guests = todo.pop()
        if name < 0:
            yield -name - 1, own, guests
            continue
        vantage, radius, inner, outer = tree[name]
        far, guest_far = (np.bitwise_count(points[x] ^ vantage).astype(np.int16)
                          for x in (own, guests))
        near = far <= radius
        todo.append((inner, own[near], guests[guest_far <= radius + bits]))
        todo.append((outer, own[~near], np.concatenate(
            [guests[guest_far > radius - bits], own[near & (far > radius - bits)]])))


def unite(label: np.ndarray, left: np.ndarray, right: np.ndarray,
          joins: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """`label` (each index's least known companion) after joining left to right. `joins`
    gets the pairs that did it, one for each group that goes into another."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right = left[apart], right[apart]
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        taken = np.flatnonzero(label[high] == low)
        taken = taken[np.unique(high[taken], return_index=True)[1]]
        joins.append((left[taken], right[taken]))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def joining(members: np.ndarray, guests: np.ndarray,
            bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among members and then guests, by index, whose groups are those of all
    links. Links between two guests are not looked for."""
    joins = [(np.arange(0), np.arange(0))]
    points = np.concatenate([members, guests])
    label = np.arange(len(points))
    tree = grow(members, math.ceil(len(members) / LEAF), bits)
    for _, own, others in dealt(tree, points, np.arange(len(members)),
                                np.arange(len(members), len(points)), bits):
        for to in range(0, len(own), LEAF):
            block = own[to:to + LEAF]
            rows = np.concatenate([own[to:], others])
            for at in range(0, len(rows), 512):
                part = rows[at:at + 512]
                i, j = np.nonzero(np.bitwise_count(
                    points[part][:, None] ^ points[block][None, :]) <= bits)
                other = part[i] != block[j]
                if other.any():
                    label = unite(label, part[i][other], block[j][other], joins)
    left, right = (np.concatenate(side) for side in zip(*joins))
    return left, right


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in at most `bits` bits, whose groups are
    those of all such pairs. `distinct` has each fingerprint once, written."""
    n = distinct.count()
    shards = max(1, min(math.ceil(n / SHARD), SAMPLE // PER_SHARD))
    tree: list[tuple] = []
    if shards > 1:
        sample = (distinct.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint")
                  .limit(shards * PER_SHARD).toPandas())
        tree = grow(sample["fingerprint"].to_numpy().view(np.uint64), shards, bits)

    def route(batches):
        for pdf in batches:
            points = pdf["fingerprint"].to_numpy().view(np.uint64)
            for shard, own, guests in dealt(tree, points, np.arange(len(points)),
                                            np.arange(0), bits):
                if len(own) + len(guests):
                    yield pd.DataFrame({
                        "shard": np.int32(shard),
                        "guest": np.repeat([False, True], [len(own), len(guests)]),
                        "fingerprint": points[np.concatenate([own, guests])].view(np.int64)})

    def answer(pdf):
        points = pdf["fingerprint"].to_numpy().view(np.uint64)
        guest = pdf["guest"].to_numpy()
        points = np.concatenate([points[~guest], points[guest]])
        a, b = joining(points[:len(points) - guest.sum()], points[len(points) - guest.sum():],
                       bits)
        return pd.DataFrame({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    return (distinct.select("fingerprint")
            .mapInPandas(route, "shard int, guest boolean, fingerprint long")
            .groupBy("shard").applyInPandas(answer, "a long, b long"))


def first_row() -> Column:
    """Of a group's rows the one that stays: by doc_id, those without one last, and text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits) and component_id of every row of
    `docs`: the least doc_id that can be reached over fingerprints differing in at most
    `bits` bits. A null or blank text has fingerprint 0 and is linked like any other;
    rows without doc_id get the least id of their component, null if it has none. Equal
    rows each give a row. `text_key` is a hash of the text, to find rows again; `kept_key`
    that of the row of its component that stays."""
    prints = materialise(fingerprints(docs, shingle))
    distinct = materialise(prints.groupBy("fingerprint").agg(first_row()))
    roots = components(links(distinct, bits)).withColumnRenamed("node", "fingerprint")
    roots = materialise(roots)
    least = (roots.join(distinct, "fingerprint").groupBy("root")
             .agg(F.min("first").alias("least")))
    named = (distinct.join(roots.join(least, "root"), "fingerprint", "left")
             .select("fingerprint", F.coalesce("least", "first").alias("least")))
    return (prints.join(named, "fingerprint")
            .select("doc_id", "text_key",
                    F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                    F.col("least.doc_id").alias("component_id"),
                    F.col("least.text_key").alias("kept_key")))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with one row of each group in `found` (doc_id, text_key, component_id,
    kept_key; written), that with the least doc_id. Of rows that share it, or of a group
    without any, one stays too."""
    out_id, out_key, own_key = unused(docs, "_out_id", "_out_key", "_key")
    stays = "doc_id <=> component_id and text_key = kept_key"
    out = found.filter(f"not ({stays})").select(
        F.col("doc_id").alias(out_id), F.col("text_key").alias(out_key)).distinct()
    key = F.xxhash64("text")
    rest = docs.join(out, docs["doc_id"].eqNullSafe(F.col(out_id))
                     & (key == F.col(out_key)), "left_anti")
    repeated = found.filter(stays).groupBy("doc_id", "text_key").count().filter("count > 1")
    if repeated.isEmpty():
        return rest
    return rest.withColumn(own_key, key).dropDuplicates(["doc_id", own_key]).drop(own_key)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """`docs` with one row of each group of near-duplicates, that with the least doc_id."""
    return keep_least(docs, materialise(near_duplicates(docs, shingle, bits)))
