"""Mixing to target weights with soft domain membership.

A classifier trained on a labelled table gives each document a posterior over
domains. Projected-gradient least squares then finds a nonnegative rate for
each document so that the expected tokens of each domain, the sum over
documents of rate * tokens * posterior, meet the targets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ranges import constants
from corpusloom.llm.batches import pieces
from corpusloom.sources.scratch import Scratch


@dataclass(frozen=True)
class MixConfig:
    """The classifier's hashed features and fit, its bounded sample, and the solver.

    ``sample_docs`` labelled documents of each domain, chosen by a hash of
    their id, are fitted. Workers turn their whole texts into cells, so the
    driver gets at most ``features`` numbers for each.
    """

    features: int = 1 << 14
    sample_docs: int = 1000
    epochs: int = 60
    rate: float = 0.5
    decay: float = 1e-5
    seed: int = 5
    iterations: int = 40
    tolerance: float = 1e-9


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    weights: np.ndarray  # (features + 1, domains); the last row is the offset

    def posterior(self, words: list[bytes]) -> np.ndarray:
        cells = _cells(words, len(self.weights) - 1)
        z = self.weights[-1].copy()
        if len(cells):
            z += self.weights[cells].sum(0) / np.sqrt(len(cells))
        e = np.exp(z - z.max())
        return e / e.sum()


def _cells(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter({zlib.crc32(w) % n for w in set(words)}, np.int64)


def _softmax_fit(x: list[np.ndarray], y: np.ndarray, w: np.ndarray, k: int, cfg: MixConfig) -> np.ndarray:
    """Weighted softmax regression by Adagrad over the whole sample."""
    n = cfg.features
    row = np.repeat(np.arange(len(x)), [len(c) for c in x])
    col = np.concatenate(x) if x else np.empty(0, np.int64)
    val = np.repeat([1 / np.sqrt(max(1, len(c))) for c in x], [len(c) for c in x])
    theta, past = np.zeros((n + 1, k)), np.full((n + 1, k), 1e-8)
    target = np.eye(k)[y]
    for _ in range(cfg.epochs):
        z = np.stack([np.bincount(row, val * theta[col, j], len(x)) for j in range(k)], 1) + theta[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - target) * (w / w.sum())[:, None]
        g = np.concatenate([np.stack([np.bincount(col, val * e[row, j], n) for j in range(k)], 1), e.sum(0, keepdims=True)])
        g += cfg.decay * theta
        past += g * g
        theta -= cfg.rate * g / np.sqrt(past)
    return theta


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], cfg: MixConfig = MixConfig()) -> DomainModel:
    """A classifier of ``domains`` from ``labelled`` (doc_id, domain) and the texts of ``docs``.

    Labels with a null or another domain, and those of documents that ``docs``
    lacks or has without text, are left out before any is counted or sampled;
    repeated labels count once, and a document of several domains counts in
    each. A domain without a labelled document gets no more than its vanishing
    prior; without any label all domains are equally likely.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(list(domains))).select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    rows = Scratch(docs.sparkSession, "labels").save(rows.distinct().join(texts.select("doc_id"), "doc_id", "left_semi"))  # joined once, read for each domain
    count = {r[0]: int(r[1]) for r in rows.groupBy("domain").count().collect()}
    h = F.xxhash64("doc_id", F.lit(cfg.seed)).alias("h")
    named = None
    for d in domains:
        part = rows.where(F.col("domain") == d).select(h, "doc_id", "domain").orderBy("h", "doc_id").limit(cfg.sample_docs)
        named = part if named is None else named.unionByName(part)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            x = [np.sort(_cells(t.lower().split(), cfg.features)).astype(np.int32) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.int32()))], ["h", "domain", "cells"])

    # sample_docs ids for each domain at most; of rows that repeat an id the least text is read.
    sampled = texts.join(F.broadcast(named), "doc_id").groupBy("h", "doc_id", "domain").agg(F.min("text").alias("text"))
    got = sampled.select("h", "domain", "text").mapInArrow(cells, "h long, domain string, cells array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["h"], r["domain"]))
    of = {d: i for i, d in enumerate(domains)}
    y = np.array([of[r["domain"]] for r in got], np.int64)
    if not len(y):
        return DomainModel(domains, np.zeros((cfg.features + 1, len(domains))))
    seen = np.bincount(y, minlength=len(domains))
    w = np.array([count[domains[i]] / seen[i] for i in y])
    return DomainModel(domains, _softmax_fit([np.array(r["cells"], np.int64) for r in got], y, w, len(domains), cfg))


def _free(name: str, docs: DataFrame) -> str:
    """``name``, or the like that no column of ``docs`` has in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_posteriors(
    docs: DataFrame, model: DomainModel, text_col: str = "text", keep_text: bool = True, names: tuple[str, str] = ("n_tokens", "posterior")
) -> DataFrame:
    """``docs`` with ``names``: the words of the whole text, and its posterior by domain; null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features * domains numbers
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: DomainModel = shared.value
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
            words = [(t or b"").lower().split() for t in texts]
            p = pa.array([m.posterior(x) for x in words], pa.list_(pa.float64()))
            columns = [batch.column(batch.schema.names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in words], pa.int64()), p], [*(f.name for f in kept), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}{', ' if kept else ''}`{names[0]}` long, `{names[1]}` array<double>")


def rate_column(history: list[np.ndarray], floor: Column | None = None, posterior: str = "posterior") -> Column:
    """A document's rate: from 1, the steps of ``history`` along its posterior, each cut off at ``floor`` (0, at most 1).

    The steps are one literal that a fold walks, so neither the plan nor the
    code that the driver compiles for it grows with them.
    """
    floor = F.lit(0.0) if floor is None else floor
    if not history:
        return F.lit(1.0)
    steps = F.array(*(constants([float(s) for s in step], "double") for step in history))

    def follow(at: Column, step: Column) -> Column:
        move = sum((F.col(posterior)[i] * step[i] for i in range(len(history[0]))), F.lit(0.0))
        return F.struct(F.greatest(at["floor"], at["r"] - move).alias("r"), at["floor"].alias("floor"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), floor.alias("floor")), follow, lambda at: at["r"])


def fit_rates(
    members: DataFrame, targets: np.ndarray, cfg: MixConfig = MixConfig(), floor: Column | None = None
) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of the solver for ``members`` (n_tokens, posterior), and the domain totals they reach.

    No rate falls below ``floor``, a column of the posterior. Where that keeps
    the targets out of reach, the totals are the nearest that the floor allows.

    Minimises the squared distance of the totals A r to ``targets`` in the
    metric of M = sum of tokens * p p', by gradient steps that are scaled by
    each document's tokens, so documents with equal posteriors get equal rates.
    With M over all documents a step of length 1 descends; M over those whose
    rate is above 0 gets there sooner and is used as long as it does descend,
    the first step, with all at 1, aside. A step that doesn't descend from a
    ``floor``, where few documents may be free, is taken back.
    Rates are a function of the steps, a few numbers each, so an iteration is
    one pass that returns a few sums; nothing of the size of the corpus is
    kept between iterations.
    """
    k, at_zero = len(targets), floor is None
    floor = F.lit(0.0) if at_zero else floor
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def passed(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p = [F.col("posterior")[i] * F.col("n_tokens") for i in range(k)]
        live = F.when((F.col("r") > floor) | F.lit(not history), 1.0).otherwise(0.0)
        got = (
            members.withColumn("r", rate_column(history, floor))
            .agg(
                *(F.sum(F.col("r") * x) for x in p),
                *(F.sum(live * p[i] * F.col("posterior")[j]) for i, j in cells),
            )
            .first()
        )
        m = np.zeros((k, k))
        for (i, j), v in zip(cells, got[k:], strict=True):
            m[i, j] = m[j, i] = v or 0.0
        return np.array([x or 0.0 for x in got[:k]]), m

    history: list[np.ndarray] = []
    totals, whole = passed(history)
    best, live, trusted = np.inf, whole, True
    for turn in range(cfg.iterations):
        off = totals - targets
        distance = float(off @ np.linalg.pinv(whole, hermitian=True) @ off)
        if np.abs(off).max() <= cfg.tolerance * max(1.0, np.abs(targets).max()) or best - distance <= cfg.tolerance * distance < np.inf and distance <= best:
            break
        if not at_zero and trusted and distance > best:
            history.pop()
            totals, trusted = before, False
            off = totals - targets
        before, trusted = totals, trusted and (at_zero or turn < cfg.iterations - 1)
        history.append(np.linalg.pinv(live if trusted and distance < best else whole, hermitian=True) @ off)
        best = min(best, distance)
        totals, live = passed(history)
    return history, totals


def copies_column(rate: Column, id_col: str = "doc_id", seed: int = 3) -> Column:
    """How often a document is taken: its rate rounded up or down by a hash of its id, right on average."""
    u = F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def target_tokens(members: DataFrame, shares: np.ndarray) -> np.ndarray:
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    return np.asarray(shares, float) / sum(shares) * total


def kept_tokens(members: DataFrame, keep: list[float | None]) -> np.ndarray:
    """Target tokens by domain, relative to the expected ones of ``members`` itself.

    A domain with a number is to have that part of its own expected tokens;
    those with None share what that leaves of all tokens, each in proportion
    to what it has, so they never have to lose any.
    """
    got = members.agg(*(F.sum(F.col("posterior")[i] * F.col("n_tokens")) for i in range(len(keep)))).first()
    own = np.array([x or 0.0 for x in got])
    rest = np.array([k is None for k in keep])
    out = own * [1.0 if k is None else k for k in keep]
    if own[rest].sum() > 0:
        out[rest] *= (own.sum() - out[~rest].sum()) / own[rest].sum()
    return out


def whole_floor(keep: list[float | None], posterior: str = "posterior") -> Column:
    """1 for a document that most likely belongs to a domain with None in ``keep``, else 0."""
    p = [F.col(posterior)[i] for i in range(len(keep))]
    best = F.array_max(posterior)
    return F.when(F.coalesce(*(F.when(x == best, F.lit(True)) for x, k in zip(p, keep, strict=True) if k is None), F.lit(False)), 1.0).otherwise(0.0)


def fitted_rate(members: DataFrame, shares: list[float | None], cfg: MixConfig, relative: bool, posterior: str = "posterior") -> Column:
    """The rate by ``shares`` of all tokens of ``members`` or, if ``relative``, of each domain's own, of a row with the column ``posterior``."""
    if not relative:
        return rate_column(fit_rates(members, target_tokens(members, np.array(shares)), cfg)[0], None, posterior)
    history = fit_rates(members, kept_tokens(members, shares), cfg, whole_floor(shares))[0]
    return rate_column(history, whole_floor(shares, posterior), posterior)


def mix_rates(
    docs: DataFrame, labelled: DataFrame, shares: dict[str, float | None], cfg: MixConfig = MixConfig(), relative: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of every row of ``docs`` (doc_id, text).

    ``shares`` are the domains' target shares of the tokens of ``docs``. If
    ``relative``, they are the parts of its own expected tokens that each
    domain keeps, and None takes what the others lose; a document that is most
    likely of a domain with None then has a rate of 1 at least. A null or
    empty text has no tokens and gets the rate of its posterior; repeated rows
    have equal rates; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit_domains(docs, labelled, tuple(shares), cfg)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = scratch.save(with_posteriors(rows, model, keep_text=False))
    out = members.withColumn("rate", fitted_rate(members, list(shares.values()), cfg, relative))
    return out.withColumn("copies", copies_column(F.col("rate")))


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float | None], cfg: MixConfig = MixConfig(), relative: bool = False) -> DataFrame:
    """``docs`` with each row as often as its rate says, in its own columns, whatever they are called; ``relative`` as in ``mix_rates``.

    A null or empty text has no tokens, so it moves no total and is taken by
    the rate of its posterior. Repeated rows have one rate and, as the hash of
    their id decides, the same number of copies each; a null id hashes like
    any other. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit_domains(docs, labelled, tuple(shares), cfg)
    members = scratch.save(with_posteriors(docs.select(F.col("text").cast("string").alias("text")), model, keep_text=False))
    names = _free("n_tokens", docs), _free("posterior", docs)
    rate = fitted_rate(members, list(shares.values()), cfg, relative, names[1])
    scratch.drop(members)
    times = F.explode(F.array_repeat(F.lit(0), copies_column(rate)))
    taken = with_posteriors(docs, model, names=names)
    return taken.select("*", times.alias(_free("copy", docs))).select(*(F.col(f"`{c}`") for c in docs.columns))
