"""I-Match fingerprints with randomised lexicons, in Spark expressions only.

The lexicon is the terms whose inverse document frequency lies in a band: it
leaves out terms that nearly every document has and terms so rare that one
edit changes the fingerprint. A document keeps its terms that are in the
lexicon, distinct and sorted; each of several random subsets of the lexicon
gives one hash of the kept terms that it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IMatchConfig:
    """Band of the document frequency (shares of all documents), and the subsets.

    The shares of all terms sum to the mean number of distinct terms in a
    document, m, so at most ``m / low`` terms reach ``low``, however large
    the corpus. ``inline`` is the checked size up to which the lexicon is
    written into the plan; a larger one is joined instead, with equal results.

    Each of ``subsets`` (at most 32) holds ``sixteenths`` / 16 of the lexicon,
    drawn for itself: the k-th holds a term whose seeded md5 has a k-th
    hexadecimal digit below ``sixteenths``. So subsets overlap, and a term may
    be in several or in none.
    """

    low: float = 0.01
    high: float = 0.25
    subsets: int = 32
    sixteenths: int = 1
    seed: int = 1
    inline: int = 20_000

    def __post_init__(self):
        if not (1 <= self.subsets <= 32 and 1 <= self.sixteenths <= 16):
            raise ValueError("1 to 32 subsets of 1 to 16 sixteenths")


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, cfg: IMatchConfig = IMatchConfig(), text_col: str = "text") -> DataFrame:
    """(term, df) of the terms whose share of all rows of ``docs`` lies in the band."""
    n = docs.count()
    df = (
        docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return df.where((F.col("df") >= cfg.low * n) & (F.col("df") <= cfg.high * n))


def subset_hashes(coded: str, own: str, cfg: IMatchConfig) -> Column:
    """The hash of each subset's terms among the sorted column ``coded`` (8 hexadecimal digits, or none), joined by ``-``.

    ``coded`` holds terms behind the 32 digits that say which subsets hold
    them. Where no subset holds any, every part is the column ``own`` instead.
    """
    none = "'d41d8cd98f00b204e9800998ecf8427e'"  # the md5 of no terms
    bar = "0123456789abcdefg"[cfg.sixteenths]
    held = lambda k: f"transform(filter({coded}, x -> substring(x, {k}, 1) < '{bar}'), x -> substring(x, 33))"
    parts = ", ".join(f"substring(replace(md5(array_join({held(k)}, ' ')), {none}, ''), 1, 8)" for k in range(1, cfg.subsets + 1))
    alone = ", ".join([own] * cfg.subsets)
    return F.coalesce(F.nullif(F.expr(f"concat_ws('-', {parts})"), F.lit("-" * (cfg.subsets - 1))), F.expr(f"concat_ws('-', {alone})"))


def likeness(a: Column, b: Column) -> Column:
    """Equal parts over those that either fingerprint has: 1 for equal ones, and at least one part is there."""
    pairs = F.arrays_zip(F.split(a, "-").alias("x"), F.split(b, "-").alias("y"))
    used = F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != ""))
    same = F.filter(used, lambda p: p["x"] == p["y"])
    return F.size(same) / F.size(used)


class Fingerprinter:
    """Fingerprints against the lexicon of one table.

    The lexicon is collected when its checked size is at most ``inline``;
    beyond it, terms are exploded, joined with the lexicon table and gathered
    again, which needs a shuffle and nothing on the driver.
    """

    def __init__(self, docs: DataFrame, cfg: IMatchConfig = IMatchConfig(), text_col: str = "text"):
        self.cfg = cfg
        self.table = lexicon(docs, cfg, text_col).select("term")
        head = self.table.limit(cfg.inline + 1).collect()
        self.words = sorted(r[0] for r in head) if len(head) <= cfg.inline else None

    def add(self, df: DataFrame, text_col: str, name: str) -> DataFrame:
        """``df`` with the fingerprint of ``text_col`` (null counts as empty) as ``name``.

        A text of which no subset holds a term has the hash of all its sorted
        terms in every part, or of the text itself if it has no term, so it is
        like its equals only. Equal texts, and so repeated rows, have equal
        fingerprints; the whole text counts, however long; all rows and
        columns stay (but one that is called ``name``), whatever they are
        called, and an empty table stays empty.
        """
        taken = {c.lower() for c in df.columns}

        def free(base: str) -> str:
            while base in taken:
                base = f"_{base}"
            return base

        key, found, kept, coded, own = (free(x) for x in ("__key", "__terms", "__kept", "__coded", "__own"))
        text = F.coalesce(F.col(text_col), F.lit(""))
        df = df.withColumn(found, terms(text))
        every = F.array_join(F.array_sort(found), " ")
        df = df.withColumn(own, F.substring(F.md5(F.when(F.size(found) > 0, every).otherwise(text)), 1, 8))
        if self.words is None:
            df = df.withColumn(key, F.sha2(text, 256))
            lists = df.select(key, found).dropDuplicates([key])
            held = lists.select(key, F.explode(found).alias("term")).join(self.table, "term")
            df = df.join(held.groupBy(key).agg(F.array_sort(F.collect_list("term")).alias(kept)), key, "left").drop(key)
            df = df.withColumn(kept, F.coalesce(kept, F.array().cast("array<string>")))
        elif self.words:  # terms are letters and digits, so they need no escape; Catalyst makes a hash set of the list
            among = ", ".join(f"'{w}'" for w in self.words)
            df = df.withColumn(kept, F.expr(f"array_sort(filter({found}, t -> t IN ({among})))"))
        else:
            df = df.withColumn(kept, F.array().cast("array<string>"))
        marked = F.transform(kept, lambda t: F.concat(F.md5(F.concat(F.lit(f"{self.cfg.seed}:"), t)), t))
        return df.withColumn(coded, marked).withColumn(name, subset_hashes(coded, own, self.cfg)).drop(found, kept, coded, own)
