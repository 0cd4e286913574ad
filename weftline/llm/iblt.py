"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has three tables of cells. A digest falls into one cell of each; a cell holds the number of
its digests and the exclusive or of them and of their checks. Subtracting the sketches of two
versions cancels what they share. Peeling then takes a cell with one digest left, notes which
version it is from, and takes it out of its other cells.

A fingerprint is a text's sketch: its digests are dealt into blocks of about four with a sketch each, so
that the work grows in proportion to the text. A block is built larger until each of its digests is
alone in a cell, so its digests can be read back. Two fingerprints are compared by what they hold and nothing
else: blocks are subtracted and peeled; where that fails, both are built again twice as large from
the digests they give back. All of it is SQL on one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.spill import stored

#: A line is cut after a sentence once a paragraph has so many characters.
PARAGRAPH = 160
#: Digests of one text in a block, at most on average, and the cells in a table of a fingerprint at each attempt.
OWN = 4
SIZES = (6, 12, 24, 48, 96, 192)
#: Digests of two versions in a block, on average, and the cells in a table at each attempt, where they are built again.
BLOCK = 8
ATTEMPTS = (3, 6, 12, 24, 48)
PEELS = 12
_GROUP = 64


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs: lines, long ones cut after sentences."""
    pattern = rf"[^\n]{{{PARAGRAPH},}}?[.!?](?= )|[^\n]+"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.xxhash64(p)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slot(digest: Column, table: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(digest, table), size)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.cast("bigint").alias("key"), check.cast("bigint").alias("check"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0), F.lit(0))


def sketch_table(items: Column, table: Column, size: Column) -> Column:
    """Cells of one table for ``items``, structs of digest and sign."""
    add = lambda cell, x: _cell(cell["n"] + x["sign"], cell["key"].bitwiseXOR(x["digest"]), cell["check"].bitwiseXOR(_check(x["digest"])))
    placed = F.transform(items, lambda x: F.struct(x["digest"].alias("digest"), x["sign"].alias("sign"), _slot(x["digest"], table, size).alias("slot")))
    cells = lambda all_: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.filter(all_, lambda x: x["slot"] == i), _zero(), add))
    return _bound(placed, cells)


def _signed(digests: Column, sign: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), F.lit(sign).alias("sign")))


def _sketch(items: Column, size: Column) -> Column:
    """The cells of all three tables."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: sketch_table(items, t, size)))


def _first(sizes: tuple[int, ...], attempt: Callable[[Column], Column], kind: str) -> Column:
    """``attempt`` at the first size for which it is not null."""
    tried = lambda found, size: F.coalesce(found, attempt(size))
    return F.aggregate(F.array(*map(F.lit, sizes)), F.lit(None).cast(kind), tried)


def _sum(a: Column, b: Column, sign: int = 1) -> Column:
    return _cell(a["n"] + b["n"] * sign, a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"]))


def _peeled(cells: Column) -> Column:
    """Number of digests of each sign that peeling recovers from a sketch, or null if cells are left."""
    size = (F.size(cells) / 3).cast("int")

    def peel(state: Column, step: Column) -> Column:
        alone = lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))

        def without(cells: Column, found: Column, table: Column) -> Column:
            return F.transform(cells, lambda c, i: F.aggregate(F.filter(found, lambda p: _slot(p["key"], table, state["size"]) == i), c, lambda c, p: _sum(c, p, -1)))

        # The tables take turns: within one, every digest is in one cell only.
        def turned(found: Column) -> Column:
            some = F.size(found) > 0
            return F.struct(
                state["size"].alias("size"),
                F.when(some, without(state["second"], found, F.pmod(step + 1, F.lit(3)))).otherwise(state["second"]).alias("first"),
                F.when(some, without(state["third"], found, F.pmod(step + 2, F.lit(3)))).otherwise(state["third"]).alias("second"),
                F.when(some, F.transform(state["first"], lambda c: F.when(alone(c), _zero()).otherwise(c))).otherwise(state["first"]).alias("third"),
                (state["added"] + F.size(F.filter(found, lambda p: p["n"] == 1))).alias("added"),
                (state["gone"] + F.size(F.filter(found, lambda p: p["n"] == -1))).alias("gone"),
            )

        return _bound(F.filter(state["first"], alone), turned)

    def end(state: Column) -> Column:
        left = F.exists(F.concat(state["first"], state["second"], state["third"]), _full)
        return F.when(~left, F.struct(state["added"].alias("added"), state["gone"].alias("gone")))

    start = F.struct(
        size.alias("size"),
        *[F.slice(cells, size * t + 1, size).alias(name) for t, name in enumerate(("first", "second", "third"))],
        F.lit(0).alias("added"),
        F.lit(0).alias("gone"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(PEELS - 1)), start, peel, end)


def _full(cell: Column) -> Column:
    return (cell["n"] != 0) | (cell["key"] != 0) | (cell["check"] != 0)


def _compared(items: Column) -> Column:
    """The digests themselves compared, for a block that no sketch could be peeled for."""
    side = lambda sign: F.transform(F.filter(items, lambda x: x["sign"] == sign), lambda x: x["digest"])
    return F.struct(
        F.size(F.array_except(side(1), side(-1))).alias("added"), F.size(F.array_except(side(-1), side(1))).alias("gone")
    )


def _difference(items: Column) -> Column:
    """How many digests only one version has, from the smallest sketch of ``items`` that peels."""
    attempt = lambda size: _bound(_sketch(items, size), _peeled)
    return F.coalesce(_first(ATTEMPTS, attempt, "struct<added:int,gone:int>"), _compared(items))


def _dealt(items: Column, blocks: Column) -> Column:
    """``items``, structs of digest and sign, by the hashes of their digests: one array for each of ``blocks``."""
    placed = F.transform(
        items,
        lambda x: F.struct(x["digest"].alias("digest"), x["sign"].alias("sign"), F.pmod(F.xxhash64(x["digest"], F.lit(7)), blocks).cast("int").alias("block")),
    )
    # Two levels keep the splitting cheap for long texts.
    groups = lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((blocks - 1) / _GROUP).cast("int")),
        lambda g: F.struct(g.alias("g"), F.filter(all_, lambda x: F.floor(x["block"] / _GROUP) == g).alias("x")),
    )
    return F.flatten(
        F.transform(
            _bound(placed, groups),
            lambda g: F.transform(
                F.sequence(g["g"] * _GROUP, F.least(g["g"] * _GROUP + _GROUP - 1, blocks - 1)),
                lambda i: F.filter(g["x"], lambda x: x["block"] == i),
            ),
        )
    )


def _total(found: Column) -> Column:
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("added"), F.lit(0).alias("gone")),
        lambda s, x: F.struct((s["added"] + x["added"]).alias("added"), (s["gone"] + x["gone"]).alias("gone")),
    )


def _share(n_a: Column, n_b: Column, total: Column) -> Column:
    return _bound(total, lambda d: F.when(n_a + n_b == 0, 1.0).otherwise((n_a - d["added"]) / (n_a + d["gone"])))


def digest_likeness(a: Column, b: Column) -> Column:
    """Share of the digests of ``a`` and ``b`` that are in both, from the peeled difference of sketches of both; 1 without any."""
    n = F.size(a) + F.size(b)
    split = _dealt(F.concat(_signed(a, 1), _signed(b, -1)), F.floor(n / BLOCK).cast("int") + 1)
    return _share(F.size(a), F.size(b), _total(F.transform(split, _difference)))


def _digests(block: Column) -> Column:
    """The digests of a block of a fingerprint: each is alone in one of its cells."""
    return F.array_distinct(F.transform(F.filter(block, lambda c: c["n"] == 1), lambda c: c["key"]))


def sketch(digests: Column) -> Column:
    """The fingerprint as an array of blocks, each the cells of its three tables.

    The number of blocks is a power of two that grows with the digests. A block takes the least of ``SIZES`` at which every
    digest is alone in a cell, so that ``_digests`` gives all back.
    """
    least = F.floor(F.greatest(F.size(digests) - 1, F.lit(0)) / OWN)
    blocks = F.when(least == 0, 1).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(least))))

    def block(items: Column) -> Column:
        whole = lambda cells, size: F.when((F.size(_digests(cells)) == F.size(items)) | (size == SIZES[-1]), cells)
        attempt = lambda size: _bound(_sketch(items, size), lambda cells: whole(cells, size))
        return _first(SIZES, attempt, "array<struct<n:int,key:bigint,check:bigint>>")

    return _bound(blocks, lambda b: F.transform(_dealt(_signed(digests, 1), b), block))


def encoded(blocks: Column) -> Column:
    """A fingerprint as text: blocks end in ``;``, cells in ``.``; a cell is its number, key and check in hexadecimal, or empty."""
    cell = lambda c: F.when(_full(c), F.concat_ws(":", F.hex(c["n"].cast("bigint")), F.hex(c["key"]), F.hex(c["check"]))).otherwise("")
    return F.array_join(F.transform(blocks, lambda b: F.array_join(F.transform(b, cell), ".")), ";")


def decoded(text: Column) -> Column:
    """The blocks of a fingerprint that ``encoded`` wrote."""
    number = lambda parts, i: F.conv(F.get(parts, F.lit(i)), 16, -10).cast("bigint")
    cell = lambda c: F.when(c == "", _zero()).otherwise(_bound(F.split(c, ":"), lambda p: _cell(number(p, 0), number(p, 1), number(p, 2))))
    return F.transform(F.split(text, ";"), lambda b: F.transform(F.split(b, r"\."), cell))


def _folded(block: Column, size: Column) -> Column:
    """A block with ``size`` cells a table, a divisor of what it has: cells of equal place modulo ``size`` add up."""
    times = (F.size(block) / (size * 3)).cast("int")
    cell = lambda k: F.aggregate(
        F.sequence(F.lit(0), times - 1),
        _zero(),
        lambda c, r: _sum(c, F.get(block, (F.floor(k / size) * size * times + F.pmod(k, size) + r * size).cast("int"))),
    )
    return F.when(times == 1, block).otherwise(F.transform(F.sequence(F.lit(0), size * 3 - 1), cell))


def _subtracted(x: Column, y: Column) -> Column:
    size = (F.least(F.size(x), F.size(y)) / 3).cast("int")
    return F.zip_with(_folded(x, size), _folded(y, size), lambda a, b: _sum(a, b, -1))


def likeness(a: Column, b: Column) -> Column:
    """Share of the digests of two fingerprints that are in both, from the fingerprints alone; 1 without any.

    With as many blocks on both sides, each is subtracted from its partner and peeled. Where cells are left, or where the numbers of blocks differ, the
    smaller one is too small for the difference, and both are built again, larger, from the digests they give back.
    """
    number = lambda blocks: F.aggregate(
        blocks, F.lit(0), lambda n, x: n + F.aggregate(F.slice(x, F.lit(1), (F.size(x) / 3).cast("int")), F.lit(0), lambda m, c: m + c["n"])
    )
    none = F.struct(F.lit(0).alias("added"), F.lit(0).alias("gone"))

    def difference(x: Column, y: Column) -> Column:
        again = F.concat(_signed(_digests(x), 1), _signed(_digests(y), -1))
        return F.when(x == y, none).otherwise(F.coalesce(_bound(_subtracted(x, y), _peeled), _bound(again, _difference)))

    alike = lambda: _share(number(a), number(b), _total(F.zip_with(a, b, difference)))
    all_ = lambda blocks: F.flatten(F.transform(blocks, _digests))
    larger = _bound(F.struct(all_(a).alias("a"), all_(b).alias("b")), lambda x: digest_likeness(x["a"], x["b"]))
    return F.when(F.size(a) == F.size(b), alike()).otherwise(larger)


def following(docs: DataFrame) -> DataFrame:
    """The next larger doc_id of each, and the smallest for the largest: (doc_id, next_id)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().repartitionByRange(parts, "doc_id")
    ids = stored(ids.withColumn("part", F.spark_partition_id()))
    # One row for each part: their number is a setting, whatever the number of documents.
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("beyond"))
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ids.withColumn("next_id", within).join(F.broadcast(firsts), "part").select("doc_id", F.coalesce("next_id", "beyond").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Digests of each document, of its edited text and of the next document.

    (doc_id, n_chars, edited_sha256, own, edited, following). The edited text has its last n_chars // 2
    characters replaced by as many of the next document's first ones. A null is an empty text. Rows that
    repeat a doc_id are each given back and share a next document; as the next document, the one
    with the smallest text counts. A row with a null doc_id has no next document: an empty text stands in.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.filter("doc_id IS NOT NULL")
    needs = known.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 2)).alias("need"))
    needs = following(docs).join(needs, "doc_id").select(F.col("doc_id").alias("before_id"), F.col("next_id").alias("doc_id"), "need")
    first = F.row_number().over(Window.partitionBy("before_id").orderBy("next_text"))
    after = known.join(needs, "doc_id").select("before_id", F.expr("substring(text, 1, need)").alias("start"), paragraph_digests(F.col("text")).alias("following"), F.col("text").alias("next_text"))
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1)
    if not repeated.isEmpty():
        after = after.withColumn("rank", first).filter("rank = 1")
    after = after.select(F.col("before_id").alias("doc_id"), "start", "following")
    half = F.floor(F.length("text") / 2)
    # The same rows meet both joins, so that the texts are shuffled once.
    alone = texts.filter("doc_id IS NULL").select("doc_id", "text", F.lit("").alias("start"), F.array().cast("array<bigint>").alias("following"))
    both = known.join(after, "doc_id", "left").unionByName(alone).select(
        "doc_id",
        "text",
        F.length("text").cast("bigint").alias("n_chars"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), (F.length("text") - half).cast("int")),
            F.coalesce(F.substring(F.col("start"), F.lit(1), half.cast("int")), F.lit("")),
        ).alias("edited_text"),
        "following",
    )
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited_text")).alias("edited"),
        F.coalesce("following", F.array().cast("array<bigint>")).alias("following"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they and the next document's are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of
    ``docs``; see ``edited_pairs`` for nulls and repeated rows. Other columns are ignored.
    """
    # One expression serves all texts, and one both comparisons: the plan stays small.
    texts = F.array("own", "edited", "following")
    sketches = edited_pairs(docs).select("doc_id", "n_chars", "edited_sha256", F.transform(texts, sketch).alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    pairs = F.array(*[F.struct(at(0).alias("a"), at(i).alias("b")) for i in (1, 2)])
    near = sketches.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.transform(F.array(at(0), at(1)), encoded).alias("f"),
        F.transform(pairs, lambda x: likeness(x["a"], x["b"])).alias("near"),
    )
    names = {"fingerprint": ("f", 0), "edited_fingerprint": ("f", 1), "near_edited": ("near", 0), "near_next": ("near", 1)}
    return near.select("doc_id", "n_chars", "edited_sha256", *[F.get(c, F.lit(i)).alias(name) for name, (c, i) in names.items()])
