"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are its words, those with a digit generalised to <*>. A tree of fixed depth leads by the number of tokens
and the first tokens to a leaf. A leaf's template has, at each place, the token of over half of the leaf's lines, else <*>.
Lines that agree with enough of it belong to it; any other line's template is its own generalised tokens. A template that
recurs in enough documents is dropped wherever it stands, but for its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parallel import spread
from .common import SPACE, cut, salted_join, with_columns_of

#: Leaves up to which their keys are broadcast (17 bytes each, some 100 in a hash table), else joined.
FEW_LEAVES = 300_000
WILD = "<*>"


def generalised(line: Column) -> Column:
    """The line's words with single spaces between, those with a digit as <*>; empty without a word.

    Lines that are so already, most of prose, are told by looking for bytes and pass as they are.
    """
    words = F.regexp_replace(line, f"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*", F.lit(WILD))
    words = F.trim(F.regexp_replace(words, f"[{SPACE}]+", F.lit(" ")))
    rough = line.rlike(r"[0-9\x09-\x0D]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(rough, words).otherwise(line)


def tokens(norm: Column) -> Column:
    return F.split(norm, " ")


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc, th, no, norm, n, l1, l2) of lines that have a word; doc and th, the text's hash, name a document, l1 and l2 a leaf."""
    # Generalised within the array, so that no filter on lines repeats the work.
    lines = F.transform(F.split("text", "\n"), generalised)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), lines.alias("lines"))  # the text is hashed before lines multiply it
    rows = rows.select("doc", "th", F.posexplode("lines").alias("no", "norm")).where("norm <> ''")
    n = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    rows = rows.select("*", n.alias("n"), F.substring_index("norm", " ", depth).alias("lead"))
    return rows.select("doc", "th", "no", "norm", "n", F.xxhash64("n", "lead").alias("l1"), F.xxhash64(F.lit(1), "n", "lead").alias("l2"))


LEAF, LINE = ["l1", "l2"], ["h1", "h2"]


def _hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes name a line's tokens, as two name a leaf."""
    return F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2")


def _by_place(found: Column, value: str) -> Column:
    """Sorted structs of `at` and `value` as an array with the value at each place and null between, so that a place is looked up at once."""
    gap = lambda e, i: e["at"] - F.when(i > 0, F.try_element_at(found, i)["at"]).otherwise(F.lit(-1)) - 1
    return F.flatten(F.transform(found, lambda e, i: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(e, i)), F.array(e[value]))))


def templates(docs: DataFrame, depth: int = 3, similarity: float = 0.7, min_docs: int = 3, long_words: int = 10) -> DataFrame:
    """(doc, th, drop, n): for each document that loses lines, an array that is 'x' at the numbers of these lines, from 0, and how many they are. See dedup_lines()."""
    lines, enough = _lines(docs, depth), lambda count: F.when(F.col("n") >= long_words, F.least(F.lit(2), F.lit(min_docs))).otherwise(F.lit(min_docs)) <= F.col(count)
    # The text is split once for the lines' keys, and once more for the tokens of leaves with different lines.
    every = cut(lines.select("doc", "th", "no", "n", "l1", "l2", *_hashes()))
    # A template that recurs in so many documents stands in a leaf with as many lines; prose has few such leaves.
    leaves = every.groupBy(*LEAF).agg(F.count("*").alias("times"), F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("n").alias("n"))
    leaves = cut(leaves.where(enough("times")).select(*LEAF, ((F.col("lo") < F.col("hi")) & (F.col("n") > depth) & (F.col("times") >= min_docs)).alias("wide")))
    many = leaves.agg(F.count("*").alias("all"), F.count_if("wide").alias("wide")).first()
    meet = lambda df, small, n, spread: df.join(F.broadcast(small), LEAF) if n <= FEW_LEAVES else salted_join(df, small, LEAF, spread)
    keys = meet(every, leaves.select(*LEAF), many["all"], F.col("h1"))
    # Only in a leaf with different lines may a template differ from its lines: each of these once, with how often it stands.
    shared = meet(lines.select(*LEAF, "norm"), leaves.where("wide").select(*LEAF), many["wide"], F.xxhash64("norm")).groupBy(*LEAF, "norm").agg(F.count("*").alias("times"))
    shared = cut(shared)
    placed = shared.select(*LEAF, "times", F.posexplode(F.slice(tokens(F.col("norm")), depth + 1, 1 << 30)).alias("at", "token"))
    token = placed.groupBy(*LEAF, "at", "token").agg(F.sum("times").alias("times"))
    totals = shared.groupBy(*LEAF).agg(F.sum("times").alias("total"))
    first = token.groupBy(*LEAF, "at").agg(F.max(F.struct("times", "token")).alias("best"))
    fixed = first.join(totals, LEAF).where("2 * best.times > total").select(*LEAF, "at", F.col("best.token").alias("fixed"))
    template = fixed.groupBy(*LEAF).agg(F.sort_array(F.collect_list(F.struct("at", "fixed"))).alias("found")).select(*LEAF, _by_place(F.col("found"), "fixed").alias("fixed"))  # at most a line's tokens
    words = salted_join(shared.select(*LEAF, "norm"), template, LEAF, F.xxhash64("norm")).select(*LEAF, "norm", "fixed", tokens(F.col("norm")).alias("words"))
    agree = F.size(F.filter(F.slice("words", depth + 1, 1 << 30), lambda x, i: x.eqNullSafe(F.get(F.col("fixed"), i)))) + depth
    members = words.where(agree >= F.size("words") * F.lit(similarity)).select(*_hashes(), F.lit(1).alias("member"))
    # A line's template: its leaf's, or itself.
    joined = salted_join(keys, cut(members), LINE, F.xxhash64("doc", "no"), "left")
    of = lambda leaf, own: F.when(F.col("member").isNotNull(), F.col(leaf)).otherwise(F.col(own))
    named = cut(joined.select("doc", "th", "no", "n", of("l1", "h1").alias("t1"), of("l2", "h2").alias("t2")))
    # The first line of a document stands for its template there, so that counting documents needs no distinct count.
    once = named.groupBy("t1", "t2", "doc", "th").agg(F.min("no").alias("no"), F.max("n").alias("n"))
    recurring = once.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "th", "no")).alias("keep"), F.max("n").alias("n")).where(enough("docs")).select("t1", "t2", "keep")
    found = salted_join(named.drop("n"), recurring, ["t1", "t2"], F.xxhash64("doc", "no"))
    gone = found.where(~F.struct("doc", "th", "no").eqNullSafe(F.col("keep")))
    gone = gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct(F.col("no").alias("at"), F.lit("x").alias("mark")))).alias("found"))
    return gone.select("doc", "th", _by_place(F.col("found"), "mark").alias("drop"), F.size("found").alias("n"))


def dedup_lines(docs: DataFrame, depth: int = 3, similarity: float = 0.7, min_docs: int = 3, long_words: int = 10, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default doc_id), text without dropped lines, n_lines and n_dropped.

    Lines end at line feeds. A template that stands in min_docs documents or more, or one of `long_words` words or more that
    stands in two, keeps its first occurrence, by doc_id (null first) and then by line; its other lines go, with their line
    feeds: short lines meet by chance, long ones hardly. Lines without a word always stay. Lines up to `depth` tokens long are
    their own templates, and so are those of a leaf with fewer than min_docs lines. Ties of a template's token: such a place is <*>. Rows equal in doc_id and text are one document, and
    each of these rows is returned; rows of one doc_id with other texts are other documents. Null texts stay null, with 0
    lines. A document may lose all lines: its text is then empty. An empty table gives no rows.
    """
    with_columns_of(docs, ["doc_id", "text"])
    docs, kept = spread(docs), [f"__k{i}" for i, _ in enumerate(keep or ["doc_id"])]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(kept, keep or ["doc_id"], strict=True)), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__th"), F.col("text").alias("__text"))
    gone = templates(docs.select("doc_id", "text"), depth, similarity, min_docs, long_words)
    both = rows.join(gone, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__th") == F.col("th")), "left")
    left = F.array_join(F.filter(F.split("__text", "\n"), lambda _, i: F.get("drop", i).isNull()), "\n")
    text = F.when(F.col("drop").isNull(), F.col("__text")).otherwise(left)
    n_lines = F.when(F.col("__text").isNull(), 0).otherwise(F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = [F.col(k).alias(c) for k, c in zip(kept, keep or ["doc_id"], strict=True)]
    return both.select(*out, text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_dropped"))


def deduped_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with what dedup_lines() leaves of their text, and its length in n_chars where docs has that; other columns as they were."""
    names = [f"__c{i}" for i, _ in enumerate(docs.columns)]
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), "doc_id", "text")
    out = dedup_lines(renamed, keep=names, **how)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))
