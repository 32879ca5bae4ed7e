"""Mixing sources to target weights by the cube method.

Each source's target over its size says how often its documents are taken: the whole part always, the fraction as an inclusion
probability. Of several equal rows, whole numbers of this probability are taken for sure and the rest is one row's. The flight phase moves these probabilities along the null space of the balancing equations, which hold a
source's total of words and of documents, until all but two or three are 0 or 1. It runs in chunks of a source; what each
chunk leaves, and a few of its documents as they are, goes to a next flight, and what the last one leaves, a handful in a
source, is landed by trying all outcomes. What
is then still wrong in the words' total, as a long document often comes last, a few exchanges of taken and untaken
documents of the last chunk make good: a correction beyond the method, which moves no total but that one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, others_hash, salted_join, with_columns_of, word_count

#: Units in a chunk of a flight, and sources up to which their table is broadcast (about 100 bytes each).
CHUNK, FEW_SOURCES = 2048, 20_000
EDGE = 1e-9
#: Units whose outcomes are all tried.
HANDFUL = 12
#: Units of a chunk, of all sizes, which go to the next flight as they are, so that the last one has units to balance by.
RESERVE = 16
KEY = ["source_key", "doc_id", "size", "h", "r"]
UNIT = "source_key string, doc_id long, size long, h long, r long, deal long, p double"
#: Rows that one step of repeating makes of a row.
AT_ONCE = 4096


def source_key(source: Column) -> Column:
    """Never null: sources' own strings get a prefix."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source_key, units, source_size, target) of (source_key, units, source_size), one row a source.

    Weights repeat over the sources in code point order, null last. The sources share `share` times all sizes by weight;
    none gets over `most` times its size, and the excess is reshared until none is above. Sources are numbered in sorted
    partitions, and a round of resharing brings two sums to the driver, so that any number of them may be many.
    """
    order = [F.col("source_key") == "n", F.col("source_key")]
    ranged = sizes.withColumn("null", order[0]).repartitionByRange("null", "source_key").sortWithinPartitions("null", "source_key")
    rows = cut(ranged.withColumn("id", F.monotonically_increasing_id()))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts, before = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect(), 0  # one row a partition
    starts = []
    for r in counts:
        starts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(sizes.sparkSession.createDataFrame(starts, "part long, before long"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("before") + place, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("part", part).join(starts, "part").select("source_key", "units", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    rows = cut(rows)
    total, full = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share, 0
    level, over = 0.0, F.lit(False)
    while before:
        held = rows.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if held[1] == 0 or (level and held[2] == full):
            break
        level, full = (total - held[0]) / held[1], held[2]
        over = F.col("cap") <= F.lit(level) * F.col("w")
    return rows.select("source_key", "units", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def flight(p: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p until at most three are neither 0 nor 1, and those can't move: sums of p * docs and p * words stay."""
    p, m, t = p.tolist(), docs.tolist(), words.tolist()
    todo = [i for i in range(len(p)) if EDGE < p[i] < 1 - EDGE][::-1]
    draws, held = iter(()), []
    while True:
        while todo and len(held) < 3:
            held.append(todo.pop())
        if len(held) < 2:
            break
        if len(held) == 3:
            i, j, k = held
            u = [m[j] * t[k] - m[k] * t[j], m[k] * t[i] - m[i] * t[k], m[i] * t[j] - m[j] * t[i]]
        else:
            u = [0.0, 0.0]
        if not any(u):  # proportional rows: two of them do
            i, j = held[:2]
            if m[i] * t[j] != m[j] * t[i]:
                break
            u = [m[j], -m[i]] if m[i] or m[j] else [1.0, 0.0]
            u += [0.0] * (len(held) - 2)
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min((1 - p[i] if x > 0 else p[i]) / abs(x) for i, x in zip(held, u, strict=True) if x)
        down = min((p[i] if x > 0 else 1 - p[i]) / abs(x) for i, x in zip(held, u, strict=True) if x)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(4096).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
        for i in held:
            p[i] = 0.0 if p[i] <= EDGE else 1.0 if p[i] >= 1 - EDGE else p[i]
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def land(p: np.ndarray, words: np.ndarray, docs: np.ndarray, swaps: int = 20) -> np.ndarray:
    """0 or 1 for the few left, so that the words' total moves least, then the documents'.

    What is left is often a long document, which moves slowly in a flight. So at most `swaps` pairs of a taken and an untaken
    unit of as many documents then change places, each as it brings the words' total nearest to what it was.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    tried = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(np.float64)
    off = [np.round(np.abs((tried - p[left]) @ x[left]), 6) for x in (docs, words)]
    out = p.copy()
    out[left] = tried[np.lexsort(off)[0]]
    for _ in range(swaps if len(left) else 0):
        over = float(np.dot(out - p, words))
        found = (abs(over), -1, -1)
        for m in np.unique(docs):
            taken, free = (x[np.argsort(words[x], kind="stable")] for x in (np.flatnonzero((out == v) & (docs == m)) for v in (1, 0)))
            if not len(taken) or not len(free):
                continue
            at = np.searchsorted(words[free], words[taken] - over)
            for j in (np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)):
                after = np.abs(over - words[taken] + words[free[j]])
                i = int(np.argmin(after))
                found = min(found, (float(after[i]), int(taken[i]), int(free[j[i]])), key=lambda x: x[0])
        if found[1] < 0:
            break
        out[found[1]], out[found[2]] = 0.0, 1.0
    return out


def _level(units: DataFrame, chunks: Column, seed: int, last: bool, reserve: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=-pdf["size"]).sort_values(["t", "h", "doc_id", "r"], na_position="last").reset_index(drop=True)  # the large first: what is left is small
        words, docs = pdf["size"].to_numpy(np.float64), np.ones(len(pdf))
        rng = np.random.default_rng([seed, int(pdf["h"].iloc[0]) & (2**64 - 1), len(pdf)])
        p = pdf["p"].to_numpy(np.float64).copy()
        fly = np.ones(len(p), bool)
        if not last:
            fly[np.linspace(0, len(p) - 1, min(len(p), reserve)).astype(int)] = False
        if not last or len(p) > HANDFUL:
            p[fly] = flight(p[fly], docs[fly], words[fly], rng)
        return pdf[[*KEY, "deal"]].assign(p=land(p, words, docs) if last else p)

    dealt = units.withColumn("chunk", F.pmod(F.xxhash64("h", "doc_id", "deal", F.lit(seed)), chunks.cast("long")))
    return dealt.groupBy("source_key", "chunk").applyInPandas(lambda pdf: run(pdf[[*KEY, "deal", "p"]]), UNIT)


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """Of rows (source_key, doc_id, size, h, r) each different one with m, how often it is there, base and extra: each of the m is taken base times, and `extra` of them once more."""
    units = cut(rows.groupBy(*KEY).agg(F.count("*").alias("m")).withColumn("g", F.xxhash64(*KEY[:-1])))
    # Units that only their other columns tell apart, however many, are dealt to chunks by these; for all others they don't matter.
    alike = cut(units.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.lit(True).alias("alike")))
    deal = F.lit(0).cast("long")
    if not alike.isEmpty():
        units, deal = salted_join(units, alike, "g", F.col("r"), "left"), F.when(F.col("alike"), F.col("r")).otherwise(F.lit(0).cast("long"))
    units = units.withColumn("deal", deal).drop("g", "alike")
    sizes = units.groupBy("source_key").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sources = cut(source_targets(sizes, weights, share, most))
    few = sources.count() <= FEW_SOURCES
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < EDGE, F.round(ratio)).otherwise(ratio)
    told = units.join(F.broadcast(sources), "source_key") if few else salted_join(units, sources, "source_key", F.col("h"))
    # Of m equal rows with the fraction f, m * f are due: the whole part for sure, the rest as a probability.
    due = F.col("m") * (ratio - F.floor(ratio))
    due = F.when(F.abs(due - F.round(due)) < EDGE, F.round(due)).otherwise(due)
    told = cut(told.select(*KEY, "deal", "m", "units", "source_size", "target", F.floor(ratio).cast("long").alias("base"), F.floor(due).cast("long").alias("sure"), (due - F.floor(due)).alias("p")))
    todo = told.where("p > 0")
    most_units = sources.agg(F.max("units")).first()[0] or 0
    chunks, level, done, reserve = F.ceil(F.col("units") / F.lit(CHUNK)), 0, [], max(0, min(RESERVE, CHUNK // 4 - 3))
    while True:
        last = most_units <= CHUNK
        moved = cut(_level(todo, chunks, seed + level, last, reserve))
        done.append(moved.where(F.col("p").isin(0.0, 1.0)))
        if last:
            break
        # A chunk leaves three units at most and its reserve; so many a source go on, dealt anew.
        most_units, level = (3 + reserve) * -(-most_units // CHUNK), level + 1
        todo = moved.where("p > 0 and p < 1")
        chunks = F.lit(max(1, -(-most_units // CHUNK)))
    drawn = done[0]
    for x in done[1:]:
        drawn = drawn.union(x)
    drawn = drawn.where("p = 1").select(*(F.col(k).alias(f"__{k}") for k in KEY))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
    both = told.join(drawn, same, "left").withColumn("extra", F.col("sure") + F.when(F.col("__source_key").isNotNull(), 1).otherwise(0))
    return cut(both.select(*KEY, "m", "source_size", "target", "base", "extra"))


def repeated(df: DataFrame, times: Column, number: str, deal: bool) -> DataFrame:
    """Each row as often as `times` says, numbered from 1; deal: what becomes many rows is dealt to many tasks first."""
    some = df.withColumn("__times", times).where("__times > 0").withColumn("__step", F.explode(F.expr(f"sequence(0L, (__times - 1) div {AT_ONCE})")))
    some = some.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if deal else some
    return some.withColumn(number, F.explode(F.expr(f"sequence(__step * {AT_ONCE} + 1, least(__times, (__step + 1) * {AT_ONCE}))"))).drop("__times", "__step")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs with size, source_size, target and taken (words, repeats counted), and copies, how often it is taken.

    The columns `keep` of docs (default doc_id) come first; they, source and text tell rows apart. Size is the number of
    words, 0 for a null text. Equal rows are taken alike but for one time, so that together they come as near to their part as
    other rows do. Null doc_ids are rows like others; a null source is a source. Documents without words are taken as others
    are, which moves no words. All sources empty: targets 0, nothing is taken. The same rows give the same mix, in any order
    and partitioning. An empty table gives no rows.
    """
    with_columns_of(docs, ["doc_id", "source", "text"])
    keep = keep or ["doc_id"]
    kept, mine = [f"__k{i}" for i, _ in enumerate(keep)], [F.col(f"`{c}`") for c in keep]
    rows = docs.select(
        source_key(F.col("source")).alias("source_key"), F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"),
        F.xxhash64(F.lit(0), *mine).alias("r"), *(c.alias(k) for c, k in zip(mine, kept, strict=True)),
    )
    plan = _plan(rows, weights, share, most, seed)
    if keep == ["doc_id"]:
        told = plan.withColumn("__k0", F.col("doc_id"))
    else:  # what the rows of a unit have in common, one of each
        one = rows.groupBy(*KEY).agg(*(F.first(k).alias(k) for k in kept)).select(*(F.col(k).alias(f"__{k}") for k in KEY), *kept)
        told = plan.join(one, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY])
    single = told.where("m = 1").withColumn("__n", F.lit(1).cast("long"))
    several = repeated(told.where("m > 1"), F.col("m"), "__n", True)
    every = single.unionByName(several).withColumn("copies", F.col("base") + F.when(F.col("__n") <= F.col("extra"), 1).otherwise(0))
    out = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
    return every.select(*out, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they were. Rows equal in all columns are taken together."""
    with_columns_of(docs, ["doc_id", "source", "text"])
    names = [f"__c{i}" for i, _ in enumerate(docs.columns)]
    keys = [source_key(F.col("source")), F.col("doc_id").cast("long"), word_count(F.col("text")), F.xxhash64("text"), others_hash(docs, ["doc_id", "source", "text"])]
    plan = _plan(docs.select(*(c.alias(k) for c, k in zip(keys, KEY, strict=True))), weights, share, most, seed)
    told = plan.select(*(F.col(k).alias(f"__{k}") for k in KEY if k != "size"), "m", (F.col("m") * F.col("base") + F.col("extra")).alias("times")).where("times > 0")
    own = [k for k in KEY if k != "size"]
    mine = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *(c.alias(k) for c, k in zip(keys, KEY, strict=True) if k != "size"))
    both = mine.join(told, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in own])
    out = repeated(both.where("m = 1"), F.col("times"), "__n", False)
    if not plan.where("m > 1").isEmpty():
        out = out.unionByName(repeated(both.where("m > 1").dropDuplicates(own), F.col("times"), "__n", True))
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
