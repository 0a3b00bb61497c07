"""Token ids of the whole corpus by corpus-level merge replay of a byte-level BPE vocabulary."""

from __future__ import annotations

import heapq
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.plans.stages import Stages

#: How byte-level BPE cuts a text into words before merging (fixed pattern of the vocabulary).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a vocabulary file of ``base64 id`` lines; ids follow the order of merges."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay(words: list[str], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every word: all merges in rank order over all words at once.

    The words lie end to end as one sequence of symbols with links to
    both neighbours.  An inverted index leads from a token pair to the positions of its left symbols.
    The pair of lowest rank is taken, its positions are merged from left to
    right, and only the pairs with the touched neighbours enter the index anew.  A merge makes a
    token of its own rank, so pairs with it rank later, and the order of ranks is kept.
    """
    symbols: list[bytes] = []
    after: list[int] = []
    before: list[int] = []
    first: list[int] = []
    for w in words:
        raw = w.encode("utf-8", "surrogatepass")
        first.append(len(symbols))
        n = len(raw)
        at = len(symbols)
        symbols.extend(raw[k : k + 1] for k in range(n))
        before.extend([-1, *range(at, at + n - 1)][:n])
        after.extend([*range(at + 1, at + n), -1][:n])
    index: dict[tuple[bytes, bytes], list[int]] = {}
    queue: list[tuple[int, bytes, bytes]] = []

    def enter(k: int) -> None:
        j = after[k]
        if j < 0:
            return
        pair = (symbols[k], symbols[j])
        found = index.get(pair)
        if found is not None:
            found.append(k)
        elif (rank := ranks.get(pair[0] + pair[1])) is not None:
            index[pair] = [k]
            heapq.heappush(queue, (rank, *pair))

    for k in range(len(symbols)):
        enter(k)
    while queue:
        _, left, right = heapq.heappop(queue)
        places = index.pop((left, right), None)
        if places is None:
            continue
        places.sort()
        whole = left + right
        for k in places:
            j = after[k]
            if symbols[k] is None or j < 0 or symbols[k] != left or symbols[j] != right:
                continue
            symbols[k] = whole
            symbols[j] = None
            nxt = after[j]
            after[k] = nxt
            if nxt >= 0:
                before[nxt] = k
                enter(k)
            if before[k] >= 0:
                enter(before[k])
    out = []
    for k in first:
        ids = []
        while k >= 0 and k < len(symbols):
            ids.append(ranks[symbols[k]])
            k = after[k]
        out.append(ids)
    return out


def encode(documents: DataFrame, id_col: str, text: str, vocabulary: str, block: int = 1000, words_a_task: int = 50_000, bytes_a_block: int = 4_000_000) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; their strings are ordinary text.

    1. Documents are dealt by hash to blocks of about ``block`` texts, or ``bytes_a_block`` where texts are long, each in one
       exchange that both the next steps read; a block gives its different words.
    2. The different words of the corpus are dealt by hash to groups of about ``words_a_task``, and
       ``replay`` merges each group.
    3. Every block gets the ids of its own words and strings its texts together.

    Only different words are exchanged, once for each block, never all positions
    of the corpus; no vocabulary of the corpus is broadcast.  Null and empty texts
    have the empty list; a null id stays null; repeated rows are encoded each.
    """
    stages = Stages(documents.sparkSession, "tokens")
    texts, size = documents.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    blocks = max(1, math.ceil(texts / block), math.ceil((size or 0) / bytes_a_block))
    # the vocabulary travels with the job, so executors need no folder of their own
    documents.sparkSession.sparkContext.addFile(vocabulary)
    shipped = os.path.basename(vocabulary)
    rows = documents.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    dealt, _ = stages.write(rows.withColumn("block", F.pmod(F.xxhash64("doc", F.coalesce(F.length("text"), F.lit(0))), F.lit(blocks)).cast("int")), "dealt")

    def different(pdf: pd.DataFrame) -> pd.DataFrame:
        import regex

        find, seen = regex.compile(WORDS).findall, set()
        for t in pdf["text"]:
            if t:
                seen.update(find(t))
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "word": sorted(seen)})

    used, _ = stages.write(dealt.groupBy("block").applyInPandas(different, "block int, word string"), "used")
    words = used.select("word").distinct()
    words, _ = stages.write(words, "words")
    groups = max(1, math.ceil(words.count() / words_a_task))
    merged = words.withColumn("g", F.pmod(F.xxhash64("word"), F.lit(groups)).cast("int"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf["word"].tolist()
        return pd.DataFrame({"word": found, "ids": replay(found, load_ranks(SparkFiles.get(shipped)))})

    table, _ = stages.write(merged.groupBy("g").applyInPandas(merge, "word string, ids array<int>"), "merged")
    own = used.join(table, "word")
    kind = documents.schema[id_col].dataType.simpleString()

    def string(key: tuple, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        import regex

        find = regex.compile(WORDS).findall
        ids = {w: list(i) for w, i in zip(known["word"], known["ids"])}
        return pd.DataFrame({id_col: texts["doc"], "ids": [[x for w in find(t) for x in ids[w]] if t else [] for t in texts["text"]]})

    return stages.result(dealt.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(string, f"{id_col} {kind}, ids array<int>"))
