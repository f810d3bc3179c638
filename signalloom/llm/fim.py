"""Fill-in-the-middle arrangement of documents, in native Spark SQL expressions only.

``regexp_extract_all`` cuts a text into units (white space and the word after it; white space at the end is a unit of its
own), so that the units joined give the text back. The first four 8-digit groups of the sha256 of seed and id are the numbers
h1 to h4: h1 and h2 choose the two cuts between units, h3 whether a document is rearranged and h4 in which order. ``slice``
and ``array_join`` make prefix, middle and suffix:

    plain  text                       psm  <P>prefix<S>suffix<M>middle                spm  <S>suffix<P>prefix<M>middle

A text that holds a sentinel stays plain, so the sentinels of an output are the only ones in it and ``restored`` parses it:
it splits at the sentinels and puts the three parts in order. No sentinel can arise where a part meets a sentinel, as long as a
sentinel's first character doesn't occur in it again (checked).

Nothing is shuffled: each row is arranged where it is read, whatever its group or source.

Edge cases: a null or empty text is plain and gives an empty output with no units; a null id is hashed as an empty one;
repeated rows are arranged alike, since the draw depends on the id alone; cuts may fall together or at the ends, which leaves
parts empty; an empty table gives no rows; the columns of docs travel in the struct ``row``, so none can clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_row

#: White space and the word after it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80


def drawn(doc_id, seed: int, k: int) -> F.Column:
    """h1 to h4: the k-th group of eight hex digits of the sha256 of seed and id, as an unsigned integer."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def arranged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """row (all columns of docs), n (units), form, prefix_chars and middle_chars (null where plain) and output.
    rate: per cent of documents to rearrange; spm: per cent of those with the suffix first; sentinels: of prefix, suffix and middle."""
    if any(s[0] in s[1:] for s in sentinels) or len({s[0] for s in sentinels}) > 1 or len(set(sentinels)) < 3:
        raise ValueError("sentinels must begin with one character that they don't hold again, and differ")
    begin, after, between = map(F.lit, sentinels)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h = [drawn(F.col(f"`{doc_id}`"), seed, k) for k in (1, 2, 3, 4)]
    held = F.lit(False)
    for s in sentinels:
        held = held | F.col("_text").contains(s)
    cut = docs.select(whole_row(docs), whole.alias("_text"), F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)).alias("_units"), *[x.alias(f"_h{k + 1}") for k, x in enumerate(h)])
    n = F.size("_units")
    form = F.when((F.col("_text") == "") | held | (F.col("_h3") % 100 >= rate), "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    placed = cut.withColumns({"n": n.cast("long"), "form": form, "_low": F.least(F.col("_h1") % (n + 1), F.col("_h2") % (n + 1)).cast("int"), "_high": F.greatest(F.col("_h1") % (n + 1), F.col("_h2") % (n + 1)).cast("int")})
    joined = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    parts = placed.withColumns({"_p": joined(F.lit(1), F.col("_low")), "_m": joined(F.col("_low") + 1, F.col("_high") - F.col("_low")), "_s": joined(F.col("_high") + 1, n - F.col("_high"))})
    psm, suffix_first = F.concat(begin, "_p", after, "_s", between, "_m"), F.concat(after, "_s", begin, "_p", between, "_m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", suffix_first).otherwise(F.col("_text"))
    return parts.select("row", "n", "form", F.length("_p").cast("long").alias("prefix_chars"), F.length("_m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output, form, sentinels: tuple[str, str, str] = SENTINELS) -> F.Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
