"""Evaluation texts leaking into training text: MinHash containment search, verified by exact shingles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.plans.stages import Stages

_REMARK = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_HYPHENS, _BREAKS = "-" + chr(0x2010) + chr(0x2011), "\r\n\x0b\x0c" + chr(0x85) + chr(0x2028) + chr(0x2029)
_HYPHEN = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*[{_BREAKS}]\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Code points, first and last, of control characters that are no space and of format and filler characters without width.
_UNSEEN = (
    (0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF),
)
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSEEN) + "]")


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared.

    Invisible characters go; remarks in brackets go; a word split by a hyphen at
    a line end is joined; compatibility forms, case and diacritics are folded; words are runs of letters and digits.
    """
    if not text:
        return []
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    if "(" in text or "[" in text:
        last = None
        while last != text:
            last, text = text, _REMARK.sub(" ", text)
    text = _HYPHEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        import regex

        text = regex.sub(r"\p{M}+", "", unicodedata.normalize("NFKD", text)).casefold()
    return _WORD.findall(text)


def _hash64(found: list[str], cache: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(cache) > 2_000_000:
        cache.clear()
    out = np.empty(len(found), dtype=np.uint64)
    for k, w in enumerate(found):
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out[k] = h
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def set_sizes(s: np.ndarray, in_run: int) -> np.ndarray:
    """How many different shingles each run of ``in_run`` of them has."""
    again = np.full(len(s), in_run)  # how far on the same shingle comes again
    for j in range(in_run - 1, 0, -1):
        same = np.flatnonzero(s[:-j] == s[j:]) if len(s) > j else np.empty(0, dtype=int)
        again[same] = j
    out = np.zeros(len(s) - in_run + 1, dtype=np.int64)
    for k in range(in_run):
        out += again[k : k + len(out)] + k >= in_run
    return out


def signatures(h: np.ndarray, run: int, shingle: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, signature) of every window of ``run`` words: how many different shingles it has, and a MinHash of ``rows`` minima, or as
    many as it has shingles; ``h`` are the hashes of the words in order."""
    n = len(h)
    if n < run:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    m = n - shingle + 1
    s = np.zeros(m, dtype=np.uint64)
    for k in range(shingle):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    in_run = run - shingle + 1
    size = set_sizes(s, in_run)
    total = np.zeros(n - run + 1, dtype=np.uint64)
    for r in range(rows):
        x = _mix(s + np.uint64(r * 0x632BE59BD9B4E019 & (2**64 - 1)))
        least = x[: n - run + 1].copy()
        for k in range(1, in_run):
            np.minimum(least, x[k : k + n - run + 1], out=least)
        total = np.where(size > r, _mix(total * np.uint64(31) + least), total)
    return size, total.view(np.int64)


def _signed(table: DataFrame, id_col: str, text: str, run: int, shingle: int, rows: int) -> DataFrame:
    """(id, size, signature, first, last): stretches of neighbouring windows with one size and signature, by their first and last word's number."""
    kind = table.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            lengths, parts = [], []
            for t in batch.column(1):
                size, total = signatures(_hash64(words(t.as_py()), cache), run, shingle, rows)
                new = np.flatnonzero(np.r_[True, (total[1:] != total[:-1]) | (size[1:] != size[:-1])][: len(total)])
                lengths.append(len(new))
                parts.append(np.column_stack([size[new], total[new], new, np.r_[new[1:], len(total)][: len(new)] + run - 2]))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            found = np.concatenate([*parts, np.empty((0, 4), dtype=np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[:, k]) for k in range(4))], names=["id", "size", "signature", "first", "last"])

    return table.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null and id is not null").mapInArrow(sign, f"id {kind}, size bigint, signature bigint, first bigint, last bigint")


def _passages(table: DataFrame, run: int) -> DataFrame:
    """(id, passage), distinct: the windows of ``run`` words of each text (id, text, stretches), of the stretches (first, last) given, or all if null."""
    kind = table.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, out = [], []
            for t, where in zip(batch.column(1), batch.column(2)):
                w, where = words(t.as_py()), where.as_py()
                spans = [(0, len(w) - 1)] if where is None else [(x["first"], x["last"]) for x in where]
                found = {" ".join(w[k : k + run]) for a, b in spans for k in range(a, b - run + 2)}
                lengths.append(len(found))
                out.extend(found)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, type=pa.string())], names=["id", "passage"])

    return table.select("id", "text", "stretches").mapInArrow(cut, f"id {kind}, passage string")


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 12, shingle: int = 5, rows: int = 3) -> DataFrame:
    """(doc_id, item_id) of documents that contain at least ``run`` consecutive words of an item.

    1. Sets: an item of whatever length is asked for by its passages of ``run`` words, each the set of its shingles, and a document, however
       long, is cut into all windows of as many words.
    2. Size partitions: passages and windows are partitioned by the number of their different shingles (repeated words make it less than
       ``run - shingle + 1``), and only sets of one partition meet.  Within a partition containment is a Jaccard similarity
       of 1, so one band finds every case, whatever the number of rows; it has ``rows`` MinHash values, or as many as the sets have shingles.
    3. Neighbouring windows with one signature are one stretch; stretches whose signature some passage has are candidates.
    4. Verification by exact containment: candidate texts are read once more, each once however many items it may contain, the
       passages of their candidate stretches cut out, and joined with the items' by their words.

    Only signatures, then passages of candidates, are exchanged, and nothing is broadcast beyond the session's
    threshold.  Items of fewer than ``run`` words cannot leak; null and empty texts give nothing; repeated rows of an id count once.
    """
    stages = Stages(documents.sparkSession, "leaks")
    wanted, _ = stages.write(_signed(items, item_id, text, run, shingle, rows).select("size", "signature").distinct(), "items")
    asked, _ = stages.write(_signed(documents, doc_id, text, run, shingle, rows).join(wanted, ["size", "signature"], "left_semi").select("id", "first", "last"), "stretches")
    where = asked.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("stretches"))  # no more than the text has words
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(where, "id")
    every = items.select(F.col(item_id).alias("id"), F.col(text).alias("text"), F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("stretches")).where("text is not null and id is not null")
    said = _passages(every, run).select(F.col("id").alias("item"), "passage").distinct()
    found = _passages(texts, run).join(said, "passage").select(F.col("id").alias(doc_id), F.col("item").alias(item_id)).distinct()
    return stages.result(found)
