"""Lines of a page reduced to shapes: what a line looks like, not what it says.

A page is cut where a line or sentence ends, and longer pieces are wrapped at LINE tokens.  Each line loses its wording in three
steps, all of them expressions of Spark: links become one sign, runs of small letters one ``a``, runs of digits one
``9``.  What is left is counted, and the counts, in coarse steps, are the line's shape:

``w``  words                    ``c``  share of capitals         ``s``  share of tokens with separators or marks that sentences lack
``l``  words a link             ``n``  share of numbers          ``p``  decimal numbers such as prices
``r``  share of different words ``h``  share of words of up to three letters
``b``  letters a word (broken encoding falls into bits)   ``e``  ends as a sentence does
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens in a line at most; longer ones are wrapped.
LINE = 12
#: A line of so many words is too short to repeat words by itself; such lines are looked at page by page.
SHORT = 4

#: Spaces and line breaks that Java's plain ``\\s`` does not know, and what they count as.
_ODD_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_ODD_BREAKS = "\x85\u2028\u2029"
#: Up to LINE tokens of which only the last may end a sentence or stand before a line break.
_LINE = rf"(?:\S++(?<![.!?…。])(?<![.!?…。][\"”»’)])[ \t\x0B\f]++){{0,{LINE - 1}}}\S++"
#: A scheme, www, or a name of several parts with a path or question behind it.
_LINK = r"(?:https?://|www\.)[^\s\p{Z}]+|[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)+[/?][^\s\p{Z}]*+"
NO_WORD = r"[^\p{L}\p{N}'’]++"
#: From a mark that sentences have none of to the token's end; a number in brackets; a label's colon.
_MARKED = r"[^\s\p{L}\p{N}\p{M}\p{C}\p{Z}.,;:!?…\"“”„’'«()–-]\S*+|\(9\)|\p{L}:"
COUNTS = ("words", "said", "different", "capitals", "tokens", "marked", "links", "numbers", "decimals", "letters", "short", "ends", "lines")


def _steps(share: Column, *cuts: float) -> Column:
    """The number of cuts that a share exceeds."""
    found = F.lit(0)
    for c in cuts:
        found = found + (share > F.lit(c)).cast("int")
    return found


def lines(pages: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, shape, the counts of COUNTS, few): every line of every page; ``shape`` is the steps as one number, ``few`` the words of a line of at
    most SHORT words without links.

    Null, empty and blank texts have no lines; no text is cut off, however long.
    """
    plain = F.translate(text, _ODD_SPACES + _ODD_BREAKS, " " * len(_ODD_SPACES) + "\n" * len(_ODD_BREAKS))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(F.octet_length(text) > F.length(text), plain).otherwise(F.col(text)).alias("text"))
    rows = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(_LINE), F.lit(0))).alias("line"))
    may_link = F.contains("line", F.lit("/")) | F.contains("line", F.lit("www.")) | F.contains("line", F.lit("?"))
    rows = rows.select("id", "line", F.when(may_link, F.regexp_replace("line", _LINK, "\u0001")).otherwise(F.col("line")).alias("bare"))
    rows = rows.select("id", "line", "bare", F.regexp_replace("bare", r"[\p{Ll}\p{M}]++", "a").alias("k"), F.split("bare", NO_WORD).alias("w"))
    words = lambda of: F.size(F.filter(F.split(of, NO_WORD), lambda x: x != ""))
    sign = lambda what: F.length("k") - F.length(F.replace(F.col("k"), F.lit(what)))
    ends = (F.col("w")[0] == "").cast("int") + (F.element_at("w", -1) == "").cast("int")
    one = F.when(F.size("w") == 1, F.size("w") - ends / 2).otherwise(F.size("w") - ends).cast("int")
    rows = rows.select("id", "line", "bare", F.regexp_replace("k", r"\p{N}++", "9").alias("k"), "w", one.alias("said"), (F.size(F.array_distinct("w")) - F.least(ends, F.lit(1))).alias("cased"), sign("\u0001").alias("links"))
    repeats = F.col("cased") <= 0.9 * F.col("said")
    rows = rows.select(
        "id", "said", "links", F.when(F.col("links") > 0, words(F.col("line"))).otherwise(F.col("said")).alias("words"),
        # capitals make words differ; only lines that repeat words at all are read again without them
        F.when(repeats, F.size(F.array_distinct(F.split(F.lower("bare"), NO_WORD))) - F.least(ends, F.lit(1))).otherwise(F.col("cased")).alias("different"),
        F.when(repeats, F.size(F.filter("w", lambda x: F.length(x).between(1, 3)))).otherwise(F.col("said")).alias("short"),
        F.regexp_count("k", F.lit(r"\p{Lu}++")).alias("capitals"), (sign(" ") + 1).alias("tokens"), F.regexp_count("k", F.lit(_MARKED)).alias("marked"), sign("9").alias("numbers"),
        F.when(sign("9") > 0, F.regexp_count("k", F.lit(r"9[.,](?:9|-)"))).otherwise(0).alias("decimals"), F.length(F.array_join("w", "")).alias("letters"),
        F.right("line", F.lit(1)).isin(".", "!", "?", "…").cast("int").alias("ends"), F.when((F.col("said") <= SHORT) & (F.col("links") == 0), F.lower("bare")).alias("few"),
    )
    n = F.greatest(F.col("said"), F.lit(1))
    return rows.where("words > 0").select("id", _shape(n).alias("shape"), *(F.lit(1).alias(c) if c == "lines" else F.col(c) for c in COUNTS), "few")


#: The parts of a shape: sign, share, cuts between its steps.
def _parts(n: Column) -> list[tuple[str, Column, tuple[float, ...]]]:
    c = F.col
    return [
        ("w", c("said"), (0, 2, SHORT, 5, 8)), ("c", c("capitals") / n, (0.25, 0.5, 0.75)), ("s", c("marked") / c("tokens"), (0, 0.25, 0.449, 0.7)),
        ("l", F.when(c("links") > 0, c("links") / n).otherwise(0), (0, 0.166, 0.333)), ("n", c("numbers") / n, (0.1, 0.249, 0.8)), ("p", c("decimals") / n, (0, 0.071)),
        ("r", c("different") / n, (0.55, 0.65, 0.75, 0.9)), ("h", c("short") / n, (0.2, 0.4)), ("b", c("letters") / n, (2.99,)), ("e", c("ends"), (0,)),
    ]


def _shape(n: Column) -> Column:
    """The steps of all parts, one decimal digit each."""
    code = F.lit(0).cast("long")
    for _, share, cuts in _parts(n):
        code = code * 10 + _steps(share, *cuts)
    return code


def shape_kinds(rows: DataFrame) -> DataFrame:
    """(shape, name, kind, pages, lines): every shape of the corpus and what it is by its own statistics over all its lines.

    ``link``      at most six other words a link
    ``product``   a decimal number every fourteen words, a quarter to four fifths of the words are numbers, and no sentence ends
    ``tag``       at least 45 of 100 tokens carry marks or separators, the words are none of the numbers' nor bits of broken encoding
    ``keyword``   six words and more of which at most 55 of 100 are different, or 75 with at most a fifth of up to three letters, as sentences need more
    ``sentence``  everything else

    Shapes are combinations of a few steps, so there are some thousands at most, however large the corpus.
    """
    s = rows.groupBy("shape").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(c).cast("double").alias(c) for c in COUNTS))
    c = F.col
    link = (c("links") > 0) & (c("said") <= 6 * c("links"))
    product = (c("decimals") > 0) & (c("said") <= 14 * c("decimals")) & (c("numbers") >= 0.25 * c("said")) & (c("numbers") <= 0.8 * c("said")) & (c("ends") < 0.5 * c("lines"))
    whole = c("letters") >= 3 * c("said")
    tag = (c("marked") >= 0.45 * c("tokens")) & (c("said") > c("lines")) & (c("numbers") < 0.8 * c("said")) & whole
    keyword = (c("said") >= 6 * c("lines")) & ((c("different") <= 0.55 * c("said")) | ((c("different") <= 0.75 * c("said")) & (c("short") <= 0.2 * c("said")))) & whole
    kind = F.when(link, "link").when(product, "product").when(tag, "tag").when(keyword, "keyword").otherwise("sentence")
    digits = F.lpad(c("shape").cast("string"), len(_parts(F.lit(1))), "0")
    name = F.concat(*(x for k, (sign, *_) in enumerate(_parts(F.lit(1))) for x in (F.lit(sign), F.substring(digits, k + 1, 1))))
    return s.select("shape", name.alias("name"), kind.alias("kind"), "pages", c("lines").cast("long").alias("lines"))
