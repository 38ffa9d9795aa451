"""Answer scoring, benchmark accuracy, losses, and teacher logits, as column and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what may stand before an answer letter.
ANSWER_PREFIX = r"^\s*(?:THE\s+)?(?:CORRECT\s+|FINAL\s+|RIGHT\s+)?(?:ANSWER\s*(?:IS\s*)?|CHOICE\s+(?:IS\s+)?)?[:.()\[\]\s]*"
#: The marked answer of a calculation, and any number.
MARKED, NUMBER = r"####\s*(-?\d+(?:\.\d+)?)", r"-?\d+(?:\.\d+)?"
LETTERS = "ABCDEFGHIJ"


def answer_letter(prediction: Column, valid: str = LETTERS) -> Column:
    """The letter right after the prefix, or null; letters further on don't count."""
    first = F.substring(F.regexp_replace(F.upper(prediction), ANSWER_PREFIX, ""), 1, 1)
    return F.when((first != "") & F.lit(valid).contains(first), first)


def letter_score(prediction: Column, target: Column, valid: str = LETTERS) -> Column:
    return F.coalesce(answer_letter(prediction, valid) == target, F.lit(False))


def plain_number(s: Column) -> Column:
    """A whole number without its decimals, anything else as it stands."""
    x = s.try_cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(s)


def predicted_number(prediction: Column) -> Column:
    """The last marked number, else the last number, else null."""
    marked = F.regexp_extract_all(prediction, F.lit(MARKED), F.lit(1))
    free = F.regexp_extract_all(prediction, F.lit(NUMBER), F.lit(0))
    return plain_number(F.coalesce(F.try_element_at(marked, F.lit(-1)), F.try_element_at(free, F.lit(-1))))


def gold_number(answer: Column) -> Column:
    """The first marked number, or null."""
    return F.nullif(F.regexp_extract(answer, MARKED, 1), F.lit(""))


def answer_to_letter(options: Column, answer: Column) -> Column:
    """The letter of the first option that equals the answer, as it stands or else trimmed; null for none."""
    exact = F.array_position(options, answer)
    loose = F.array_position(F.transform(options, lambda o: F.trim(F.coalesce(o, F.lit("")))), F.trim(F.coalesce(answer, F.lit(""))))
    at = F.when(exact > 0, exact).when(loose > 0, loose)
    return F.substring(F.lit(LETTERS), at.cast("int"), F.lit(1))


def choices(options: list[Column]) -> Column:
    """The options that say something."""
    return F.filter(F.array(*options), lambda o: o.isNotNull() & ~o.isin("", "N/A"))


def lettered(options: Column) -> Column:
    """The options of an array, whole, a line each: ``A. first``, ``B. second``."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


def choice_block(question: Column, options: Column, letter: Column | None = None) -> Column:
    """A whole question with its lettered options and its answer's letter, or room for it."""
    end = F.lit("\nAnswer:") if letter is None else F.concat(F.lit("\nAnswer: "), letter)
    return F.concat(F.lit("Q: "), question, F.lit("\n"), lettered(options), end)


def passage_prompt(passage: Column, question: Column, options: Column) -> Column:
    """A whole passage and question with lettered options and room for the letter."""
    return F.concat(F.lit("Passage: "), passage, F.lit("\nQuestion: "), question, F.lit("\n"), lettered(options), F.lit("\nAnswer:"))


def worked_block(question: Column, answer: Column | None = None) -> Column:
    """A whole question with its worked answer, or room for it."""
    return F.concat(F.lit("Q: "), question, F.lit("\nA:") if answer is None else F.concat(F.lit("\nA: "), answer))


def few_shot_prompt(shots: Column, target: Column) -> Column:
    """The blocks of the array ``shots`` and then the target's, parted by blank lines."""
    return F.array_join(F.concat(shots, F.array(target)), "\n\n")


def gold_letter(answer: Column, index: Column, valid: str = LETTERS) -> Column:
    """The answer's letter, trimmed in upper case, if it is a valid one; else that of the index, from 0."""
    given = F.upper(F.trim(answer))
    by_index = F.substring(F.lit(LETTERS), (index + 1).cast("int"), F.lit(1))
    return F.when((F.length(given) == 1) & F.lit(valid).contains(given), given).otherwise(F.nullif(by_index, F.lit("")))


def subgroup_key(metadata: Column, name: str, default: str = "unknown") -> Column:
    """What the metadata map has under ``name``, or the default."""
    return F.coalesce(F.try_element_at(metadata, F.lit(name)), F.lit(default))


def accuracy(scored: DataFrame) -> DataFrame:
    """(bench, subgroup, n, n_correct, accuracy) of ``scored`` (bench, subgroup, correct); a null subgroup is the whole."""
    right = F.count_if("correct")
    n = F.count(F.lit(1))
    rows = scored.groupingSets([["bench"], ["bench", "subgroup"]], "bench", "subgroup")
    return rows.agg(n.alias("n"), right.alias("n_correct"), F.round(right / F.greatest(F.lit(1), n), 9).alias("accuracy"))


def source_loss(tokens: DataFrame) -> DataFrame:
    """(source, n_tokens, loss, ppl) of ``tokens`` (batch, source, nll, weight); a null source is all of them.

    A batch with a loss that isn't finite is left out as a whole, and so is a
    source without weight; tokens of no source count in the whole only.
    """
    finite = ~(F.isnan("nll") | F.col("nll").isin(float("inf"), float("-inf"))) & F.col("nll").isNotNull()
    bad = tokens.where(~finite).select("batch").distinct()
    good = tokens.join(bad, "batch", "left_anti").withColumn("lost", F.col("nll") * F.col("weight"))
    sums = [F.sum("lost").alias("l"), F.sum("weight").alias("w"), F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).cast("long").alias("n_tokens")]
    each = good.where("source IS NOT NULL").groupBy("source").agg(*sums)
    whole = good.agg(*sums).select(F.lit(None).cast("string").alias("source"), "l", "w", "n_tokens")
    out = each.unionByName(whole).where("w > 0").withColumn("loss", F.col("l") / F.col("w"))
    return out.select("source", "n_tokens", "loss", F.exp(F.least("loss", F.lit(50.0))).alias("ppl"))


def few_shot_split(rows: DataFrame, group: str, key: str, shots: int, seed: int = 0, most: int | None = None) -> DataFrame:
    """``rows`` with ``is_shot``: per group the first ``shots`` by a seeded hash; groups too small for a test row go.

    The first of each of 64 parts of a group hold the first of the group, so
    no group is sorted in one place. ``most`` keeps that many test rows of a
    group, the next by the hash.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    marked = rows.withColumn("__h", h).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    need = shots + (most or 0)
    inner = F.row_number().over(Window.partitionBy(group, "__part").orderBy("__h", key))
    first = marked.select(group, key, "__h", "__part").withColumn("__r", inner).where(F.col("__r") <= need)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__h", key))
    first = first.withColumn("__rank", rank).where(F.col("__rank") <= need).select(group, key, "__rank")
    big = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= shots + 1).select(group)
    out = marked.join(F.broadcast(big), group, "left_semi").join(first, [group, key], "left").drop("__h", "__part")  # a row for each group
    if most is not None:
        out = out.where("__rank IS NOT NULL")
    return out.withColumn("is_shot", F.coalesce(F.col("__rank") <= shots, F.lit(False))).drop("__rank")


def shots_from_train(train: DataFrame, test: DataFrame, key: str, shots: int, seed: int = 0) -> DataFrame:
    """Both tables as rows with ``is_shot``: the first ``shots`` of ``train`` by a seeded hash, or of ``test`` where that is empty, and all of ``test``."""
    source = train if train.head(1) else test
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    picked = source.orderBy(h, key).limit(shots).withColumn("is_shot", F.lit(True))
    return picked.unionByName(test.withColumn("is_shot", F.lit(False)))


def top_k(logits: Column, k: int) -> Column:
    """The k largest as (value, index) structs, largest first, the lower index among equals."""
    marked = F.transform(logits, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(marked), 1, k), lambda s: F.struct((-s.v).alias("value"), s.i.alias("index")))


def top_k_mass(logits: Column, k: int) -> Column:
    """The share of the softmax that the k largest have."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    add = lambda a, x: a + x
    return F.aggregate(F.slice(F.sort_array(e, asc=False), 1, k), F.lit(0.0), add) / F.aggregate(e, F.lit(0.0), add)


def mass_summary(masses: DataFrame, by: str = "k") -> DataFrame:
    """Mean, percentiles (interpolated) and shares strictly below .90, .95 and .99 of ``mass``."""
    below = [F.avg((F.col("mass") < t).cast("double")).alias(f"below_{int(t * 100)}") for t in (0.90, 0.95, 0.99)]
    points = [F.percentile("mass", p / 100).alias(f"p{p}") for p in (10, 50, 90, 99)]
    return masses.groupBy(by).agg(F.avg("mass").alias("mean"), *points, *below)


def recommend_k(summary: DataFrame, column: str = "below_95", most: float = 0.1) -> DataFrame:
    """The smallest k whose share below is at most ``most``, else the largest."""
    return summary.agg(F.coalesce(F.min(F.when(F.col(column) <= most, F.col("k"))), F.max("k")).alias("k"))


def range_lookup(positions: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """``positions`` (pos) joined with the range [start, end) of ``ranges`` that holds it; uncovered ones get nulls.

    Both sides are cut at multiples of ``width``, so it is an equi join that
    then compares, whatever the number of ranges.
    """
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    p = positions.withColumn("__cell", F.floor(F.col("pos") / width))
    on = (p["__cell"] == cells["__cell"]) & (p["pos"] >= cells["start"]) & (p["pos"] < cells["end"])
    return p.join(cells, on, "left").drop("__cell")


def coverage_gaps(ranges: DataFrame) -> DataFrame:
    """(gap_start, gap_end) between ranges by start; ranges are few, one row for each shard."""
    w = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("gap_start", F.max("end").over(w))
    return out.where("gap_start < start").select("gap_start", F.col("start").alias("gap_end"))


def element_mean(vectors: Column, rows: DataFrame, by: list[str]) -> DataFrame:
    """The element-wise mean of an array column over each group, as (…, pos, mean)."""
    return rows.select(*by, F.posexplode(vectors).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def nucleus(rows: DataFrame, logits: str, by: str, top_p: float, temperature: float = 1.0) -> DataFrame:
    """(by, rank, index, p): the most likely indices whose summed softmax is at most ``top_p``, at least one, scaled to 1.

    Equal logits rank by index. A row's places are summed in one window, so
    only one row's logits meet.
    """
    places = rows.select(by, F.posexplode(logits).alias("index", "z")).withColumn("z", F.col("z").cast("double") / max(temperature, 1e-8))
    row = Window.partitionBy(by)
    e = F.exp(F.col("z") - F.max("z").over(row))
    places = places.withColumn("e", e).withColumn("q", F.col("e") / F.sum("e").over(row))
    order = row.orderBy(F.col("q").desc(), "index")
    ranked = places.withColumn("rank", F.row_number().over(order)).withColumn("cum", F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("cum") <= top_p) | (F.col("rank") == 1))
    return kept.select(by, "rank", "index", (F.col("q") / F.sum("q").over(row)).alias("p"))


def draw(kept: DataFrame, by: str, seed: int) -> DataFrame:
    """(by, index): one index of each row of :func:`nucleus`, by a uniform number hashed from the seed and the row."""
    u = F.xxhash64(F.col(by), F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    cum = F.sum("p").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = kept.withColumn("cum", cum).withColumn("u", u)
    reach = F.when(F.col("cum") > F.col("u"), F.struct(F.lit(0).alias("late"), F.col("rank").alias("r"), F.col("index").alias("i")))
    late = F.struct(F.lit(1).alias("late"), (-F.col("rank")).alias("r"), F.col("index").alias("i"))
    return marked.groupBy(by).agg(F.min(F.coalesce(reach, late)).alias("m")).select(by, F.col("m.i").alias("index"))


def position_sample(positions: DataFrame, key: str, batch: int, whole: int, n: int, seed: int = 0) -> DataFrame:
    """``n`` of the positions of the first ``whole`` batches of ``batch`` positions, by a seeded hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return positions.where(F.col(key) < batch * whole).orderBy(h, key).limit(n)


def sequence_sample(total: int, n: int, seed: int = 0) -> list[int]:
    """The ids of ``n`` sequences drawn without repeats."""
    import random

    return sorted(random.Random(seed).sample(range(total), min(n, total)))
