"""Near-duplicate documents by ProbMinHash signatures over weighted word shingles.

The probability Jaccard similarity of two weighted sets a and b is the sum, over shared
elements i, of 1 / sum_j max(a_j / a_i, b_j / b_i). Each shingle starts a Poisson process whose rate is
its number of occurrences, with arrivals at random components; the shingle of the first arrival at a
component is its value. A component agrees between two texts with that similarity as probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.components import connected_components, merged_components
from weftline.llm.spill import splittable, stored
from weftline.llm.textarrays import chunks, mix, shingle_hashes, text_bytes, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Turns in which each bucket compares its texts to one of them.
TURNS = 2
#: In buckets of more texts than LARGE, one of so many texts is compared in a turn.
LARGE, ONE_OF = 64, 8
#: Texts in a block of those that meet in the end.
BLOCK = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text with their counts, (text, shingle, count) sorted; and the word hashes with their bounds."""
    data, offsets = text_bytes(column)
    values, first = word_hashes(data, offsets)
    shingle, text, _ = shingle_hashes(values, first, size)
    order = np.argsort(shingle)
    narrow = np.uint16 if len(column) < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(narrow), kind="stable")]
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(np.append(at, len(text))), values, first


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signature of ``size`` shingles for each of ``texts`` texts; all zero without a shingle.

    Each round draws the next arrival of every shingle still at work. A shingle ends with its
    first arrival later than what every component of its text already holds, since arrivals
    only get later.
    """
    best, value = np.full(texts * size, np.inf), np.zeros(texts * size, np.uint64)
    limit = np.full(texts, np.inf)
    time, rate = np.zeros(len(text)), weight.astype(float)
    step = np.zeros(1, np.uint64)
    while len(text):
        step += _STEP
        draw = mix(shingle ^ mix(step))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        early = time < limit[text]
        text, shingle, rate, time, draw = text[early], shingle[early], rate[early], time[early], draw[early]
        cell = text * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        value[cell[won]] = shingle[won]
        open_texts = np.flatnonzero(np.bincount(text, minlength=texts))
        limit[open_texts] = best.reshape(texts, size)[open_texts].max(axis=1)
    return value.reshape(texts, size)


def _sketch_rows(words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                text, shingle, count, values, first = weighted_shingles(part.column("text"), words)
                n = part.num_rows
                found = signatures(text, shingle, count, n, bands * rows).reshape(n, bands, rows)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (n, bands))
                for i in range(rows):
                    key = mix(key * np.uint64(3) ^ found[:, :, i])
                has = np.bincount(text, minlength=n) > 0
                flat = pa.array(key[has].astype(np.uint64).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(has * bands)), pa.int32()), flat
                )
                raw = values.tobytes()
                content = [
                    xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None
                    for a, b in zip(first[:-1].tolist(), first[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(content, pa.binary()), lists], ["doc_id", "content", "bands"]
                )

    return sketch


def probability_jaccard(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
) -> float:
    """Exact similarity of two weighted sets, each its sorted distinct elements and their weights."""
    shared, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1].astype(float), b[1].astype(float)
    only_a, only_b = x.sum() - x[at_a].sum(), y.sum() - y[at_b].sum()
    x, y = x[at_a], y[at_b]
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # For element i, max(x_j / x_i, y_j / y_i) is the first where x_j / y_j is at least x_i / y_i.
    from_x, to_y = np.cumsum(x[::-1])[::-1], np.append(0, np.cumsum(y)[:-1])
    return float((1 / ((from_x + only_a) / x + (to_y + only_b) / y)).sum())


def _similar_rows(words: int):
    def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        text, shingle, count, _, _ = weighted_shingles(column, words)
        cut = np.searchsorted(text, np.arange(1, len(column)))
        return list(zip(np.split(shingle, cut), np.split(count, cut)))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a", 1 << 19):
                for piece in chunks(part, "text_b", 1 << 19):
                    pairs = zip(sets(piece.column("text_a")), sets(piece.column("text_b")))
                    found = [probability_jaccard(a, b) for a, b in pairs]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("a"), piece.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"]
                    )

    return similar


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts reach ``similarity``: (a, b, similarity)."""
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    # Rounding must not lose a pair that lies exactly at the threshold.
    return both.mapInArrow(_similar_rows(words), "a bigint, b bigint, similarity double").filter(
        F.col("similarity") >= similarity - 1e-9
    )


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star(placed: DataFrame, turn: int) -> DataFrame:
    """Each text of a bucket with one text of it, another in every bucket and turn, unless their component is the same.

    A text in large buckets tries some of them only; what it misses is left to ``_across``.
    """
    by = F.struct(F.xxhash64("doc", "bucket", F.lit(turn)), "doc", "component")
    centres = placed.groupBy("bucket").agg(F.max(by).alias("centre"))
    some = placed.filter((F.col("n") <= LARGE) | (F.pmod(F.xxhash64("doc", "bucket", F.lit(turn), F.lit(1)), F.lit(ONE_OF)) == 0))
    both = some.join(splittable(centres, "bucket"), "bucket").filter("component <> centre.component")
    return both.select(*_ordered(F.col("doc"), F.col("centre.doc"))).distinct()


def _links_between(docs: np.ndarray, component: np.ndarray, side: np.ndarray, column: pa.Array, words: int, similarity: float) -> list[tuple[int, int]]:
    """A similar pair of texts for each two components that have one, from the texts of two blocks or within one.

    The probability Jaccard similarity is at most the share of either text's weight that lies on elements
    of the other. Products of matrices give these shares; only pairs that reach the threshold by both go on.
    """
    text, shingle, count, _, _ = weighted_shingles(column, words)
    n = len(docs)
    order = np.argsort(shingle)
    ranked = shingle[order]
    which = np.cumsum(np.append(True, ranked[1:] != ranked[:-1])) - 1 if len(ranked) else np.zeros(0, np.int64)
    often = np.bincount(which)[which] > 1 if len(which) else np.zeros(0, bool)
    rows, weights = text[order][often], count[order][often].astype(np.float64)
    columns = np.cumsum(np.append(True, np.diff(which[often]) > 0)) - 1 if often.any() else np.zeros(0, np.int64)
    shared = np.zeros((n, n))
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        part = slice(*np.searchsorted(columns, [low, low + 4096]))
        mass = np.zeros((n, 4096))
        mass[rows[part], columns[part] - low] = weights[part]
        shared += mass @ (mass > 0).T
    total = np.bincount(text, count, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.nan_to_num(shared / total[:, None])
    near = (share >= similarity - 1e-9) & (share.T >= similarity - 1e-9) & (component[:, None] < component[None, :])
    if len(set(side.tolist())) > 1:
        near &= side[:, None] != side[None, :]
    cut = np.searchsorted(text, np.arange(1, n))
    sets = list(zip(np.split(shingle, cut), np.split(count, cut)))
    links: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        pair = component[i], component[j]
        if pair not in links and probability_jaccard(sets[i], sets[j]) >= similarity - 1e-9:
            links[pair] = docs[i], docs[j]
    return list(links.values())


def _across(placed: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between texts that buckets connect and whose components differ: (a, b), one for two components in a block.

    Texts that buckets connect are dealt into blocks, and two blocks meet in a task, which gives back
    links only. Its size is that of two blocks, however many texts are connected. The texts of a crowd's largest
    component have blocks of their own, which meet only those of the other texts: within it all are linked already.
    """
    centres = placed.groupBy("bucket").agg(F.min("doc").alias("b"))
    edges = placed.join(splittable(centres, "bucket"), "bucket").select(F.col("doc").alias("a"), "b")
    groups = connected_components(edges).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
    members = stored(placed.select("doc", "component").distinct().join(groups, "doc"))
    counts = members.groupBy("crowd", "component").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("crowd").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).select(
        "crowd",
        F.col("main.component").alias("main"),
        (F.floor(F.col("main.n") / BLOCK) + 1).alias("main_blocks"),
        (F.floor((F.col("n") - F.col("main.n")) / BLOCK) + 1).alias("blocks"),
    )
    dealt = members.join(splittable(sizes, "crowd"), "crowd")
    own, spread = F.col("component") == F.col("main"), F.xxhash64("doc")
    dealt = dealt.withColumn("side", F.when(own, F.col("blocks") + F.pmod(spread, "main_blocks")).otherwise(F.pmod(spread, "blocks")))
    dealt = dealt.withColumn("last", F.col("blocks") - 1 + F.when(own, 0).otherwise(F.col("main_blocks")))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    met = met.join(texts.withColumnRenamed("doc_id", "doc"), "doc")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = (table.column(name).to_numpy() for name in ("doc", "component", "side"))
        links = _links_between(*columns, table.column("text").combine_chunks(), words, similarity)
        return pa.table({name: pa.array([x[k] for x in links], pa.int64()) for k, name in enumerate("ab")})

    meeting = met.select(
        "crowd", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "doc", "component", "side", "text"
    )
    return meeting.groupBy("crowd", "low", "high").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Class of each document: (doc_id, class_id), the smallest doc_id that verified links lead to.

    Texts with the same words in the same order are one class at once and go on as one. In a few
    turns, one text of each bucket is compared to the others. A large group of copies thereby grows
    together without all its pairs. Texts of buckets that then still span several components are
    compared block by block, so no link between components is passed over. With copies spread about the
    threshold that step is the only one that grows faster than the group does.

    Texts without a word, nulls among them, are in no group: their class is their own doc_id, or
    null without one. Texts of fewer than ``words`` words only match equal ones. Rows with a null doc_id
    match nothing; rows that repeat a doc_id count as one document. Other columns are ignored.
    """
    plain = docs.select("doc_id", "text")
    sketched = stored(
        plain.mapInArrow(_sketch_rows(words, bands, rows), "doc_id bigint, content binary, bands array<bigint>")
    )
    known = sketched.filter("doc_id IS NOT NULL AND content IS NOT NULL")
    distinct = known.groupBy("content").agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands"))
    members = distinct.select("doc", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = stored(members.join(splittable(shared, "bucket"), "bucket"))
    texts = stored(plain.join(crowd.select(F.col("doc").alias("doc_id")).distinct(), "doc_id"))

    placed = crowd.withColumn("component", F.col("doc"))
    components = None
    for turn in range(TURNS + 1):
        if turn < TURNS:
            found = verified(_star(placed, turn), texts, words, similarity).select("a", "b")
        else:
            found = _across(placed, texts, words, similarity)
        found = stored(found)
        if turn and found.isEmpty():
            continue
        components = merged_components(components, found) if turn else connected_components(found)
        if turn == TURNS:
            break
        joined = crowd.join(components, F.col("doc") == F.col("node"), "left")
        placed = joined.select("bucket", "n", "doc", F.coalesce("component", "doc").alias("component"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        placed = stored(placed.join(mixed.filter("low < high").select("bucket"), "bucket"))

    placed = distinct.select("content", "doc").join(components, F.col("doc") == F.col("node"), "left")
    # A null content joins nothing.
    classes = sketched.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("content")).alias("content")).join(
        placed.select("content", F.coalesce("component", "doc").alias("class_id")), "content", "left"
    )
    # A doc_id with several texts lies in the smallest of their classes.
    return classes.groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that give their class its id, in the columns of ``docs``: one of each class.

    Texts that share a doc_id are documents of their own, by ascending text. Of equal rows, in doc_id and text, one
    stays. Rows with a null doc_id all stay.
    """
    unnamed = docs.filter("doc_id IS NULL")
    if docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 AND doc_id IS NOT NULL").isEmpty():
        kept = near_duplicates(docs).filter("doc_id = class_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").unionByName(unnamed)
    # Numbers in the order of (doc_id, text) take the place of doc_id, one for each row.
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    placed = stored(rows.sort("doc_id", "text").withColumn("place", F.monotonically_increasing_id()))
    # The id has the partition in its high bits and the place within it in the low ones, so it rises in sort order.
    numbered = placed.select(F.col("place").alias("doc_id"), "text")
    kept = near_duplicates(numbered).filter("doc_id = class_id").select(F.col("doc_id").alias("place"))
    found = placed.join(kept, "place", "left_semi")
    # Texts without a word are in no class: of those that are equal, one stays too.
    rank = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("place"))
    found = found.withColumn("rank", rank).filter("rank = 1")
    return found.select("row.*").unionByName(unnamed)
