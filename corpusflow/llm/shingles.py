"""SimHash near-dedup up to a similarity of word shingles, the pipeline's stage.

A text's set has the XXH64 hashes of its runs of `width` words. Two texts are linked if their sets' Jaccard similarity is
`least` or more. Candidates are the texts of one component of SimHash's ball hashing, by the sets' fingerprints, and those
that share a band of MinHash values: at 0.8 fingerprints are some ten bits apart, and balls that wide can't be spelled out.
Each pair in a bucket is compared exactly; of a bucket beyond TILE members, each pair of blocks is a task of its own. With
40 bands of 4, a pair at 0.8 shares no bucket with probability 7e-10, nearer pairs less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, heads_only, over_arrow, row_keys, with_columns_of
from .simhash import _word_blocks, fingerprint_roots, majority

BANDS, ROWS, TILE = 40, 4, 512
#: Candidates up to which their ids are broadcast, else joined.
FEW_TEXTS = 100_000
_RNG = np.random.default_rng(42)
_TIMES, _PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Of UTF-8, sorted, each once; A-Z in lower case, words between ASCII white space. Fewer words are one shingle, none is 0."""
    found, held = [], []
    for words in _word_blocks((text or b"").lower()):
        words = held + words
        if len(words) >= width:
            found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))), "<u8", len(words) - width + 1)))
        held = words[max(0, len(words) - width + 1) :] if width > 1 else []
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held)) if held else 0], "<u8")
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        least = np.minimum(least, (found[i : i + 512, None] * _TIMES + _PLUS).min(0))
    raw = least.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * j : 8 * ROWS * (j + 1)], j) for j in range(BANDS)], np.uint64).view(np.int64)


def similar_pairs(sets: list[np.ndarray], least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), i < j, of sets whose Jaccard similarity is least[0] / least[1] or more, by exact counts."""
    sizes = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), sizes)
    shared = times[at] > 1
    who, at = who[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    both, step = np.zeros((len(sets), len(sets)), np.int64), 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        some = slice(*np.searchsorted(at, [lo, lo + step]))
        has = np.zeros((len(sets), step), np.float32)
        has[who[some], at[some] - lo] = 1
        both += (has @ has.T).astype(np.int64)
    # both / (sizes - both) >= p / q
    p, q = least
    return np.nonzero(np.triu((p + q) * both >= p * (sizes[:, None] + sizes[None, :]), 1))


def _sets(docs: DataFrame, width: int, keys: bool) -> DataFrame:
    """(doc_id, th, rk, same, and fp, keys or set): th is the text's hash, same that of its set, fp the set's fingerprint."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "th", "rk", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x.as_py(), width) for x in b.column(3)]
            same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            arrays, names = [*b.columns[:3], pa.array(same)], ["doc_id", "th", "rk", "same"]
            if keys:
                fp = np.array([np.packbits(2 * majority(s) > len(s), bitorder="little").view("<u8")[0] for s in found], np.uint64).view(np.int64)
                arrays, names = [*arrays, pa.array(fp), pa.array([band_keys(s) for s in found], pa.list_(pa.int64()))], [*names, "fp", "keys"]
            else:
                arrays, names = [*arrays, pa.array([s.tobytes() for s in found], pa.binary())], [*names, "set"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return over_arrow(rows, run, "doc_id long, th long, rk long, same long, " + ("fp long, keys array<long>" if keys else "set binary"))


def _tiles(nodes: DataFrame) -> DataFrame:
    """(tile, same): the members of each bucket of two or more; buckets of the same members count once."""
    spread = nodes.select("same", F.explode("keys").alias("key"))
    bucket = "over (partition by key)"
    met = spread.select("same", F.expr(f"count(*) {bucket}").alias("n"), F.expr(f"bit_xor(xxhash64(same)) {bucket}").alias("x"), F.expr(f"bit_xor(xxhash64(7, same)) {bucket}").alias("y"))
    met = met.where("n > 1").distinct()
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "same"), F.col("blocks")).cast("int"))
    # Every two blocks of a bucket meet in a tile; a lone block is a tile.
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("block")))
    met = met.withColumn("other", F.explode(other))
    return met.select(F.xxhash64("x", "y", "n", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "same")


def _links(members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b) over members (tile, node, set): pairs enough to join whatever is similar within a tile."""

    def linked(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root, out = list(range(len(nodes))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(*(x.tolist() for x in similar_pairs(sets, least)), strict=True) if len(nodes) > 1 else ():
            if (x := find(i)) != (y := find(j)):
                root[y] = x
                out.append((nodes[i], nodes[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, nodes, sets = None, [], []
        send = lambda x: pa.RecordBatch.from_arrays([pa.array([p[i] for p in x], pa.int64()) for i in (0, 1)], names=["a", "b"])
        for b in batches:
            out = []
            for t, node, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t != tile:
                    out += linked(nodes, sets)
                    tile, nodes, sets = t, [], []
                nodes.append(node)
                sets.append(np.frombuffer(s, "<u8"))
            if out:
                yield send(out)
        if out := linked(nodes, sets):
            yield send(out)

    bounded_batches(members.sparkSession)
    return over_arrow(members.select("tile", "node", "set").repartition("tile").sortWithinPartitions("tile"), run, "a long, b long")


def one_of_similar(docs: DataFrame, width: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs with one row of each group of texts that links of similarity join, that of least doc_id; columns as they were.

    Null and empty texts, and those of white space, are alike. Rows of one doc_id are judged by their own texts. Rows without
    doc_id go where a row with one stays; of equal rows one stays. An empty table gives no rows.
    """
    texts = with_columns_of(docs, ["doc_id", "text"]).select(*row_keys(docs)[:2], "text")
    rows = cut(_sets(docs.select(*row_keys(docs), "text"), width, keys=True))
    # Each different set once, with the row that is asked for it.
    nodes = rows.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")).alias("head"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut(nodes)
    near = fingerprint_roots(nodes).select("fp", F.array(F.xxhash64(F.lit("ball"), "root")).alias("ball"))
    tiles = cut(_tiles(nodes.join(near, "fp").select("same", F.concat("keys", "ball").alias("keys"))))
    wanted = cut(tiles.select("same").distinct().join(nodes.select("same", F.col("head.doc_id").alias("__id"), F.col("head.th").alias("__th")), "same"))
    heads = wanted.select("__id", "__th")
    chosen = texts.join(F.broadcast(heads) if wanted.count() <= FEW_TEXTS else heads, texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["th"] == F.col("__th")), "left_semi")
    sets = _sets(chosen.withColumn("rk", F.lit(0).cast("long")), width, keys=False).groupBy("same").agg(F.first("set").alias("set"))
    found = connected_components(_links(tiles.join(sets, "same").withColumnRenamed("same", "node"), least))
    labels = nodes.select("same").join(found, F.col("same") == F.col("node"), "left").select("same", F.coalesce("root", "same").alias("root"))
    return heads_only(docs, rows, labels, "same")
