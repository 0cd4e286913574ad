"""Line-first cleaning: lines that fail a rule go, and so do documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textarrays import byte_hashes, chunks, shingle_hashes, text_bytes, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document goes if failed lines hold more than this share of its characters in words.
MAX_LOST_PERCENT = 50

# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "released under",
    "share this",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "uses cookies",
)
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SYMBOL_RUN = "[#*$%&|<>]{2,}"
# Marks that end a sentence in the scripts of the world, those that close or join one, and a line's last
# characters that show it to be prose.
SENTENCE_ENDS = ".!?…։؟۔।॥။၏።፧។៕᙮᠃‼‽⁇⁈⁉⸮。．！？｡︒﹒﹖﹗꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
CLOSERS = "\"'”’»›)]}）］｝」』】〕〉》｣:;：；、，,"
ENDING = rf"""[{re.escape(SENTENCE_ENDS + CLOSERS)}][\x20\x09-\x0D]*$"""
#: A line with other endings fails if it has fewer words, or if no line follows that may go on with it.
SHORT_LINE = 6

#: A line that may go on with the one before: it begins with no capital letter, bullet or mark of a table.
GOES_ON = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D\p{Lu}#*|<>•\-]"

_WORD, _SYMBOL_RUN, _ENDING = re.compile(WORD), re.compile(SYMBOL_RUN), re.compile(ENDING.replace("$", r"\Z"))
_GOES_ON = regex.compile(GOES_ON)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])

QUALITY = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,lost_chars:bigint,kept:boolean,cleaned:string>"
)


def line_fails(line: str, found: list[str], after: str = "") -> bool:
    """Whether a line with the words ``found`` fails a rule: punctuation, navigation or boilerplate.

    A line without an ending of prose passes if it is long and the line right ``after`` it may go on with the sentence.
    """
    return (
        not (_ENDING.search(line) or (len(found) >= SHORT_LINE and _GOES_ON.search(after)))
        or 2 * sum(word.endswith("!!") for word in found) > len(found)
        or line.count("|") >= 2
        or 2 * len(_SYMBOL_RUN.findall(line)) > len(found)
        or _BOILERPLATE.search(line.translate(_LOWER)) is not None
    )


def clean(text: str) -> tuple[int, int, str]:
    """Of a text: lines with a word that equal an earlier one, characters in words of failed lines, and the other lines."""
    seen, repeats, lost, kept = set(), 0, 0, []
    lines = text.split("\n")
    for line, after in zip(lines, [*lines[1:], ""]):
        found = _WORD.findall(line)
        if found:
            repeats += line in seen
            seen.add(line)
            if line_fails(line, found, after):
                lost += sum(map(len, found))
                continue
        kept.append(line)
    return repeats, lost, "\n".join(kept)


def repeated_words(values: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Number of words of each text that lie in windows of ``window`` words found twice or more in it."""
    hashes, text, at = shingle_hashes(values, first, window)
    if not len(hashes):
        return np.zeros(len(first) - 1, np.int64)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order], kind="stable")]
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = at[order[np.append(False, same) | np.append(same, False)]]
    change = np.zeros(len(values) + window + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    covered = np.append(0, np.cumsum(np.cumsum(change)[: len(values)] > 0))
    return covered[first[1:]] - covered[first[:-1]]


def _quality_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.RecordBatch.from_arrays([batch.column("row"), pc.struct_field(batch.column("row"), "text")], ["row", "text"])
        for part in chunks(texts, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, first = words(data, offsets)
            values = byte_hashes(data, starts, ends)
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            in_words = np.append(0, np.cumsum(points[ends] - points[starts]))
            symbols = np.append(0, np.cumsum(_IS_SYMBOL[data]))[offsets]
            n_words, chars = np.diff(first), in_words[first[1:]] - in_words[first[:-1]]
            repeats = repeated_words(values, first, WINDOW)
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            lines = [clean(text or "") for text in part.column("text").to_pylist()]
            lost = np.array([x[1] for x in lines], np.int64)
            fields = {
                "n_words": pa.array(n_words),
                "word_chars": pa.array(chars),
                "n_symbols": pa.array(np.diff(symbols)),
                "n_dup_lines": pa.array([x[0] for x in lines], pa.int64()),
                "n_repeat_words": pa.array(repeats),
                "base_failed": pa.array(failed),
                "lost_chars": pa.array(lost),
                "kept": pa.array(~failed & (100 * lost <= MAX_LOST_PERCENT * chars)),
                "cleaned": pa.array([x[2] for x in lines], pa.string()),
            }
            quality = pa.StructArray.from_arrays(list(fields.values()), list(fields))
            yield pa.RecordBatch.from_arrays([part.column("row"), quality], ["row", "quality"])


def line_quality(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, and the struct ``quality`` of its measures and verdict.

    A document is kept if it has at least 20 words, windows of 8 words found twice or more hold at most 30 %
    of its words, and lines that fail hold at most half of its characters in words. ``cleaned`` is
    the text without failed lines. A null or empty text has no words and is not kept. Rows are judged one
    by one, so repeated rows have equal verdicts; other columns are carried along in ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(_quality_rows, f"row {rows.schema['row'].dataType.simpleString()}, quality {QUALITY}")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents kept, with their cleaned text, in the columns of ``docs``."""
    judged = line_quality(docs).filter("quality.kept")
    new = {"text": F.col("quality.cleaned"), "n_chars": F.length("quality.cleaned").cast("bigint")}
    return judged.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
    ), lines AS (
        SELECT doc_id, parts[k] AS line, coalesce(parts[k + 1], '') AS after
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(body, chr(10)) AS parts FROM texts))
    ), judged AS (
        SELECT doc_id, line, ws, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
               NOT (regexp_matches(line, {_quoted(ENDING)}) OR (len(ws) >= {SHORT_LINE} AND regexp_matches(after, {_quoted(GOES_ON)})))
               OR 2 * len(list_filter(ws, lambda w: ends_with(w, '!!'))) > len(ws)
               OR length(regexp_replace(line, '[^|]', '', 'g')) >= 2
               OR 2 * len(regexp_extract_all(line, '{SYMBOL_RUN}')) > len(ws)
               OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(BOILERPLATE)}')
               AS fails
        FROM (SELECT doc_id, line, after, regexp_extract_all(line, '{WORD}') AS ws FROM lines)
        WHERE len(ws) > 0
    ), by_line AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost
        FROM judged GROUP BY doc_id
    ), windows AS (
        SELECT doc_id, pos, list_slice(ws, pos, pos + {WINDOW - 1}) AS words
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS pos FROM texts)
    ), twice AS (
        SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, words) AS n FROM windows) WHERE n > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + {WINDOW})) AS place FROM twice) GROUP BY doc_id
    ), measured AS (
        SELECT texts.doc_id, len(ws)::BIGINT AS n_words,
               coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
               coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
               coalesce(lost, 0)::BIGINT AS lost_chars
        FROM texts LEFT JOIN by_line ON texts.doc_id = by_line.doc_id LEFT JOIN covered ON texts.doc_id = covered.doc_id
    ), based AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
           NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
    FROM based
"""
