"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its shingles. Two fingerprints are
linked if at most `radius` bits differ. Each distinct fingerprint emits all variants within half the radius; two that are
linked share a variant, and all that share one lie within the radius of each other. So the members of a bucket, at most
1 + 64 for radius 2, need a link to its least member only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, heads_only, over_arrow, row_keys, salted_join, with_columns_of

#: Texts longer than this are cut at white space and taken in turn.
BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while len(text) - at > BLOCK:
        gap = _GAP.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Of UTF-8; A-Z in lower case, words between ASCII white space, shingles of `width` words, all repeats. No word: 0."""
    digest, ones, total, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in _word_blocks((text or b"").lower()):
        words = held + words
        if len(words) >= width:
            hashes = np.fromiter((digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))), "<u8", len(words) - width + 1)
            ones += majority(hashes)
            total += len(hashes)
        held = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if not total:
        return digest(b" ".join(held), seed) if held else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of 64 bits, in how many hashes each is set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def fingerprints(docs: DataFrame, width: int = 3, carry: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, fp) and what is carried, longs: a row for each row of docs; fp is the fingerprint as a signed long. A null text is an empty one."""
    bounded_batches(docs.sparkSession)
    with_columns_of(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carry)
    names = ["doc_id", "fp", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), *b.columns[2:]], names=names)

    return over_arrow(rows, run, ", ".join(f"{n} long" for n in names))


def ball(radius: int, bits: int = 64) -> list[int]:
    """What to flip for every variant within `radius`, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) over nodes (node, fp) of distinct fingerprints: enough verified links to join whatever lies within `radius`."""
    if radius % 2:
        raise ValueError("radius must be even: only then do all of a bucket lie within it")
    masks = F.explode(F.array(*(F.lit(m) for m in ball(radius // 2))))
    spread = nodes.select("node", "fp", masks.alias("mask")).select("node", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    first = F.expr("min(struct(node, fp)) over (partition by variant)")
    met = spread.withColumn("first", first).where("node <> first.node")
    checked = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= radius)
    return checked.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def fingerprint_roots(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root): each different fp of rows once, with the least one that it reaches by links.

    A fingerprint is its own node, so that no id that stands on several rows can join what isn't near.
    """
    nodes = cut(rows.select("fp").distinct().select("fp", F.col("fp").alias("node")))
    found = connected_components(link_fingerprints(nodes, radius))
    return nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of docs.

    Equal fingerprints, and those within `radius` bits, link; component_id is the least doc_id reachable. Links go by
    fingerprints alone: rows of one doc_id with other texts are apart, unless these link. Rows without doc_id link like others
    and get their component's id, null if none of its rows has one. Null and empty texts have fingerprint zero and link like
    any other. Other columns are ignored. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, width))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = cut(fingerprint_roots(least, radius).join(least, "fp"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = salted_join(rooted.select("fp", "root"), heads, "root", F.col("fp")).select("fp", "component_id")
    told = salted_join(rows, labels, "fp", F.col("doc_id"), "left")
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """docs with one row of each component of near_duplicates(): that of least doc_id; columns as they were.

    Rows of one doc_id are judged by their own texts. Rows without doc_id go where a row with one stays; of equal rows one stays.
    """
    rows = cut(fingerprints(docs, width, tuple(row_keys(docs)[1:])))
    return heads_only(docs, rows, fingerprint_roots(rows, radius), "fp")
