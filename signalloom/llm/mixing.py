"""Mixing sources to target weights: iterative proportional fitting, DataFrame functions only.

Documents are first summed to cells (source, language, topic), a pre-aggregated group-by; all iterations run on the
cells. A sweep rakes the cells' token weights to the target shares of each marginal in turn: the marginal's sums,
pre-aggregated, are joined back to the cells, or where there are ``CELLS`` at most taken over windows of one partition. Cells are written to the shared checkpoint folder every ``CUT`` sweeps, so
plans stay short; after ``SWEEPS`` of them raking goes on until the largest difference of a marginal share from its
target, the residual, is at most ``TOLERANCE`` (``MOST`` sweeps at most). The residual is a column of the result.
The raked weight of a cell over its tokens, times the budget, is the rate at which its documents are taken: whole copies
for its integer part and one more with the rest's probability, by a hash of the id and the text that any engine can
repeat. Rows that agree in both are told apart by a number of the row, so that each copy is drawn for itself.

Without repeats no cell can give more tokens than it has. Targets that ask for more are cut to what there is and the rest
goes to the other values in proportion, each step of raking keeps cells under that limit, and at the end what is left of
the budget is spent on cells that have tokens left; the residual then tells what the limits didn't allow.

Topics and token counts are given columns, or else the surface form of the text and a token for every four bytes.
Targets default to tempered corpus shares: tokens to the power ``alpha``, normalised in each marginal. Edge cases: a null
source or language is a value of its own, '(none)'; a null or empty text has topic 'empty' and no tokens, and is never
taken; given targets for values that no document has are left out and the others normalised to 1, values without a
target get none; rows with a null id are drawn by their text, repeated rows each for itself (which copies are taken then depends
on the order of the table's files; how many doesn't); an empty table gives no rows; extra columns are kept by ``mix``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_or_cold, stored, whole_row

SWEEPS, CUT, ALPHA, MOST, TOLERANCE = 12, 3, 0.7, 36, 1e-6
#: Cells up to which sums and cells are broadcast.
CELLS = 100_000
NONE = "(none)"


def topic_of(text) -> F.Column:
    """A surface topic: the form a text has."""
    shown = F.coalesce(text, F.lit(""))
    return F.when(F.length(shown) == 0, "empty").when(shown.contains(" | "), "table").when(shown.contains("***") | shown.contains("###"), "symbols").when(shown.contains("icense"), "license").otherwise("prose")


def tokens_of(text) -> F.Column:
    """Estimated tokens: one for every four bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


MARGINALS = ("source", "lang", "topic")


def with_cells(docs: DataFrame, text: str = "text", topic: str | None = None, tokens: str | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens): documents with their cell; row holds all their columns. topic, tokens: columns of
    docs that have them."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    counted = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else tokens_of(F.col(text))
    own = [named("source").alias("source"), named("lang").alias("lang"), (named(topic) if topic else topic_of(F.col(text))).alias("topic"), counted.alias("tokens")]
    return docs.select(whole_row(docs), *own)


def _summed(frame: DataFrame, key: str | None, small: bool, **sums) -> tuple[DataFrame, list]:
    """(frame, sums of expressions over the rows that share key). A small frame lies in one partition, so that windows over it
    need no shuffle; otherwise the sums are pre-aggregated and joined."""
    if small:
        window = Window.partitionBy(*([key] if key else []))
        return frame, [F.sum(e).over(window) for e in sums.values()]
    have = frame.groupBy(*([key] if key else [])).agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    return (frame.join(have, key) if key else frame.join(F.broadcast(have))), [F.col(f"_{n}") for n in sums]


def _residual(cells: DataFrame) -> float:
    """The largest difference of a marginal share from its target."""
    each = [cells.groupBy(name).agg(F.abs(F.sum("weight") - F.max(f"to_{name}")).alias("d")).select("d") for name in MARGINALS]
    return each[0].unionByName(each[1]).unionByName(each[2]).agg(F.max("d")).first()[0] or 0.0


def _within(share: DataFrame, small: bool, rounds: int = 6) -> DataFrame:
    """Target shares (value, share, most) cut to what there is (most), the rest going to the others in proportion."""
    under = F.col("share") < F.col("most")
    for _ in range(rounds):
        share, (free, full) = _summed(share, None, small, free=F.when(under, F.col("share")).otherwise(0.0), full=F.when(under, 0.0).otherwise(F.col("most")))
        grown = F.least(F.col("most"), F.col("share") * F.greatest(F.lit(0.0), 1 - full) / free)
        share = share.select("value", F.when(under, grown).otherwise(F.col("most")).alias("share"), "most")
    return share


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, limit: float | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``weight``, raked shares of the total, and ``residual``. targets: for a marginal
    a DataFrame (value, share); where one is missing, tempered shares. limit: a cell's weight is at most its share of all
    tokens over this budget."""
    cells = cut(cells.where("tokens > 0"))
    number, everything = cells.agg(F.count("*"), F.sum("tokens")).first()
    if not number:
        return cells.select(*MARGINALS, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("residual"))
    small = number <= CELLS
    together = lambda frame: frame.coalesce(1) if small else frame
    # columns, no constants: the plans of all sweeps are the same, so that their code is compiled once
    cells = cells.withColumn("most", F.col("tokens") / F.lit(everything * limit) if limit else F.lit(None).cast("double"))
    for name in MARGINALS:
        known = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("all"), F.sum("most").alias("most"))
        given = (targets or {}).get(name)
        present = together(known.withColumn("share", F.pow("all", F.lit(alpha))) if given is None else known.join(given, "value"))
        present, (whole,) = _summed(present, None, small, whole=F.col("share"))
        share = present.select("value", (F.col("share") / whole).alias("share"), "most")
        share = (cut(_within(share, small)) if limit else share).select(F.col("value").alias(name), F.col("share").alias(f"to_{name}"))
        cells = cells.join(F.broadcast(share) if small else share, name, "left").withColumn(f"to_{name}", F.coalesce(f"to_{name}", F.lit(0.0)))
    columns = [*MARGINALS, "tokens", "most", *[f"to_{n}" for n in MARGINALS]]
    cells = cut(together(cells.select(*columns, (F.col("tokens") / F.lit(everything)).alias("weight"))))
    sweep, residual = 0, float("inf")
    while sweep < sweeps or (residual > TOLERANCE and sweep < MOST):
        for _ in range(min(CUT, sweeps - sweep) if sweep < sweeps else CUT):
            for name in MARGINALS:
                cells, (have,) = _summed(cells, name, small, have=F.col("weight"))
                raked = F.when(have > 0, F.col("weight") * F.col(f"to_{name}") / have).otherwise(F.lit(0.0))
                cells = cells.select(*columns, F.least(raked, "most").alias("weight"))  # least() skips the null of no limit
            sweep += 1
        cells = cut(cells)
        if sweep >= sweeps:
            before, residual = residual, _residual(cells)
            if limit and residual > 0.9 * before:
                break  # the limits don't allow more
    if limit:  # what is left of the budget
        for _ in range(4):
            under = F.col("weight") < F.col("most")
            cells, (full, free) = _summed(cells, None, small, full=F.col("weight"), free=F.when(under, F.col("weight")).otherwise(0.0))
            grown = F.when(under & (free > 0), F.col("weight") * (1 + (1 - full) / free)).otherwise(F.col("weight"))
            cells = cells.select(*columns, F.least(grown, "most").alias("weight"))
        cells = cut(cells)
        residual = _residual(cells)
    return cells.select(*MARGINALS, "tokens", "weight", F.lit(residual).alias("residual"))


def uniform(doc_id, text, copy=None, salt: str = "mix") -> F.Column:
    """A number in [0, 1) from the md5 of the id, the text's md5 and a number that tells copies apart (null: there are none)."""
    parts = [doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(None).cast("string") if copy is None else copy.cast("string"), F.lit(salt)]
    named = F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(own: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds ``copy``: null for rows whose id and text no other row has, a number of the row for the others. Only hashes are
    shuffled, pre-aggregated; the rows are written once where there are copies, so that their numbers are settled."""
    key = F.xxhash64(F.col("row")[doc_id], F.col("row")[text])
    repeated = own.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    number, rows = repeated.agg(F.count("*"), F.sum("_n")).first()
    if not number:
        return own.withColumn("copy", F.lit(None).cast("long"))
    numbered = stored(own.withColumn("_key", key).withColumn("copy", F.monotonically_increasing_id()))
    if number <= CELLS:
        found = numbered.join(F.broadcast(repeated.withColumn("_met", F.lit(True)).drop("_n")), "_key", "left")
        return found.withColumn("copy", F.when(F.col("_met"), F.col("copy"))).drop("_key", "_met")
    met = hot_or_cold(numbered, repeated, "_key", "_n", rows)
    alone = numbered.join(repeated, "_key", "left_anti").withColumn("copy", F.lit(None).cast("long"))
    return met.unionByName(alone).drop("_key")


def mix(docs: DataFrame, keep: float = 0.5, repeats: bool = True, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, sweeps: int = SWEEPS, doc_id: str = "doc_id", text: str = "text", topic: str | None = None, tokens: str | None = None) -> DataFrame:
    """The documents taken: row (all their columns), source, lang, topic, tokens, weight (raked share of the cell), rate,
    copies and residual. keep: the budget as a share of all tokens. Without repeats a document is taken once at most."""
    own = with_copies(with_cells(docs, text, topic, tokens), doc_id, text)
    cells = cut(rake(own.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), targets, alpha, sweeps, None if repeats else keep))
    total = cells.agg(F.sum("tokens").alias("all"))
    rates = cells.join(F.broadcast(total)).select(*MARGINALS, "weight", "residual", (F.col("weight") * keep * F.col("all") / F.col("tokens")).alias("rate"))
    if not repeats:
        rates = rates.withColumn("rate", F.least("rate", F.lit(1.0)))
    # a shuffle would move the texts: cells go to the documents, after their number is checked
    joined = own.join(F.broadcast(rates) if cells.count() <= CELLS else rates, list(MARGINALS))
    whole = F.floor("rate")
    copies = (whole + (uniform(F.col("row")[doc_id], F.col("row")[text], F.col("copy")) < F.col("rate") - whole).cast("long")).cast("int")
    return joined.withColumn("copies", copies).where("copies > 0 and tokens > 0").select("row", *MARGINALS, "tokens", "weight", "rate", "copies", "residual")
