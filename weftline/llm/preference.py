"""Preference pairs: the common start of two conversations as one prompt, the rest as two masked completions.

All of it is SQL; a pair is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.spill import splittable

#: Rows of a group of conversations that meet one copy of the conversation they are paired with.
SALT_ROWS = 1000


def turns_of(conversations: DataFrame, key: str) -> DataFrame:
    """Turns of each conversation in order: (key, turns). Repeated rows count once; a null turn comes first.

    Different rows of one turn are all kept, by role and then by text; a null role or text counts as empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(key).agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """Character spans of the rendered turns that count for the loss: the texts of the assistant and the line ends after them.

    The length so far runs along the turns, which are taken in blocks of about the root of their number: no array
    that grows with the conversation is copied for every turn.
    """
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + 6
    none = F.array().cast("array<struct<from:int,to:int>>")
    n = F.greatest(F.size(turns), F.lit(1))
    width = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1, width), lambda k: F.slice(turns, k + 1, width))

    def spans(block: Column, start: Column) -> Column:
        step = lambda s, t: F.struct(
            (s["at"] + size(t)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(s["spans"], F.array(F.struct((s["at"] + size(t) - F.length(t["text"]) - 1).alias("from"), (s["at"] + size(t)).alias("to")))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        )
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("spans")), step)

    def add(state: Column, block: Column) -> Column:
        found = F.array(spans(block, state["at"]))
        return F.aggregate(
            found,
            state,
            lambda s, x: F.struct(x["at"].alias("at"), F.concat(s["parts"], F.array(x["spans"])).alias("parts")),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<from:int,to:int>>>").alias("parts"))
    return F.flatten(F.aggregate(blocks, start, add)["parts"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Prompt and completions of ``pairs`` (pair_id, chosen_id, chosen, rejected), the last two arrays of turns.

    (pair_id, chosen_id, n_prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss). The prompt is the longest common
    start, by role and text; it is rendered once and counts for no loss. A completion is what follows; of it, the
    spans of characters in the loss columns count. Equal conversations have two empty completions, and
    a null or empty conversation has no turn. Repeated rows and null ids are formatted like any other.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    pairs = pairs.select("pair_id", "chosen_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False).cast("int")
    pairs = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("c")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    pairs = pairs.select("pair_id", "chosen_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("start"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        "pair_id",
        "chosen_id",
        F.col("n").alias("n_prompt_turns"),
        render(F.col("start")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c")).alias("chosen_loss"),
        loss_spans(F.col("r")).alias("rejected_loss"),
    )


def pairs_by_first_turn(conversations: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Pairs of conversations with an equal first turn: (pair_id, chosen_id, chosen, rejected).

    ``conversations`` has conv_id, turn, role and text. In each group the conversation of the smallest
    conv_id is the chosen one, and every other is the rejected one of a pair that its conv_id names.
    A group may be any share of all conversations: its rows meet as many copies of the
    chosen one as its size asks for. Rows with a null conv_id are left out.
    """
    turns = turns_of(conversations.filter("conv_id IS NOT NULL"), "conv_id")
    head = F.get("turns", F.lit(0))
    keyed = turns.select("conv_id", F.xxhash64(head["role"], head["text"]).alias("k"), F.xxhash64(head["text"], F.lit(1)).alias("k2"))
    groups = keyed.groupBy("k", "k2").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.withColumn("salts", F.floor(F.col("n") / salt_rows) + 1).drop("n")
    members = keyed.join(splittable(groups, "k"), ["k", "k2"]).filter("conv_id <> chosen_id")
    members = members.select("conv_id", "chosen_id", F.pmod(F.xxhash64("conv_id"), F.col("salts")).alias("salt"))
    copies = groups.select("chosen_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    chosen = copies.join(turns.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    rejected = members.join(turns.withColumnRenamed("turns", "rejected"), "conv_id")
    return rejected.join(chosen, ["chosen_id", "salt"]).select(F.col("conv_id").alias("pair_id"), "chosen_id", "chosen", "rejected")


def pairs_with_cut_reply(conversations: DataFrame) -> DataFrame:
    """Each conversation chosen over itself with its last turn cut to half its characters.

    (pair_id, chosen_id, chosen, rejected), both ids its conv_id. Rows with a null conv_id are left out.
    """
    turns = turns_of(conversations.filter("conv_id IS NOT NULL"), "conv_id")
    last = F.element_at("turns", -1)
    half = F.substring(last["text"], F.lit(1), F.floor(F.length(last["text"]) / 2).cast("int"))
    cut = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), half.alias("text"))
    rejected = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(cut))
    return turns.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


SQL = """
    WITH turns AS (
        SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS turns
        FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        GROUP BY conv_id
    ), grouped AS (
        SELECT conv_id, turns, min(conv_id) OVER (PARTITION BY turns[1].role, turns[1].text) AS chosen_id FROM turns
    ), pairs AS (
        SELECT r.conv_id AS pair_id, r.chosen_id, c.turns AS c, r.turns AS r,
               len(list_filter(range(1, least(len(c.turns), len(r.turns)) + 1),
                   lambda i: list_transform(c.turns[1:i], lambda t: struct_pack(a := t.role, b := t.text))
                             = list_transform(r.turns[1:i], lambda t: struct_pack(a := t.role, b := t.text)))) AS n
        FROM (
            SELECT * FROM grouped WHERE conv_id <> chosen_id
            UNION ALL
            SELECT conv_id, turns[1:len(turns) - 1] || [struct_pack(turn := turns[-1].turn, role := turns[-1].role,
                                                                     text := left(turns[-1].text, length(turns[-1].text) // 2))],
                   conv_id AS chosen_id FROM turns
        ) AS r JOIN turns AS c ON r.chosen_id = c.conv_id
    ), parts AS (
        SELECT pair_id, chosen_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM pairs
    )
    SELECT pair_id, chosen_id, n::INTEGER AS n_prompt_turns,
           array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '') AS prompt,
           array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '') AS chosen,
           array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '') AS rejected,
           array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
               (list_sum(list_transform(c[1:i], lambda t: length(t.role) + length(t.text) + 6)) - length(c[i].text) - 1)::BIGINT || '-'
               || list_sum(list_transform(c[1:i], lambda t: length(t.role) + length(t.text) + 6))::BIGINT), ' ') AS chosen_loss,
           array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
               (list_sum(list_transform(r[1:i], lambda t: length(t.role) + length(t.text) + 6)) - length(r[i].text) - 1)::BIGINT || '-'
               || list_sum(list_transform(r[1:i], lambda t: length(t.role) + length(t.text) + 6))::BIGINT), ' ') AS rejected_loss
    FROM parts
"""
