"""Language proportions of documents by expectation-maximisation.

Training counts hashed byte trigrams by language over every labelled row (one partial
table per task, so the shuffle is bounded by languages x 65,536 per task) and turns
them into smoothed log-likelihoods: a model of fixed size per language.

Inference cuts a text into segments of ``SEGMENT`` bytes.  A segment is written in one
language; its likelihood under each language is the product of its trigrams'.  The
document is a mixture of languages, whose proportions EM estimates.  The set of
languages is grown one by one from the best single language, as long as the
log-likelihood rises by more than a penalty, ``PENALTY + log(segments) / 2`` for each
further proportion.  All documents of a batch are estimated at once (numpy).

Results: ``lang_pred`` is the language with the largest proportion (of equal ones the
first by name), ``score`` its proportion, ``shares`` the proportions of the selected
set.  A null text, a text without a letter, or a model without languages gives ``und``
with score 0 and no shares.  Texts are used whole; rows are independent, so repeated
rows get equal results; input columns pass through and must not clash with ``names``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.llm.common import chunks, flat

CELLS = 1 << 16
SEGMENT = 48
PENALTY = 12.0
ROUNDS = 12
CHUNK = 1 << 20
UNKNOWN = "und"
NAMES = ("lang_pred", "score", "shares")

_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 0x20, np.uint8)                      # letters in lower case, the rest blank
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Cell of the trigram that starts at each byte but the last two."""
    x = _CLASS[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray                 # CELLS x languages


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        smoothing: float = 0.5) -> Model:
    """Trigram model of every value of ``lang_col`` over all rows where it is not null."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.int64)
            data, offsets = flat(batch.column("text"))
            for i, j in chunks(offsets, CHUNK):
                part = data[offsets[i]:offsets[j]]
                if len(part) < 3:
                    continue
                owner = np.repeat(number[i:j], np.diff(offsets[i:j + 1]))
                cell = owner[:-2] * CELLS + trigrams(part)
                ends = offsets[i + 1:j] - offsets[i]            # trigrams across two texts
                whole = np.ones(len(cell), bool)
                for back in (1, 2):
                    cross = ends - back
                    whole[cross[(cross >= 0) & (cross < len(cell))]] = False
                n = np.bincount(cell[whole], minlength=len(names) * CELLS).reshape(-1, CELLS)
                for k, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + n[k]
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(n[at].astype(np.int64))], names=["lang", "cell", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).alias("text")).where("lang IS NOT NULL")
    counts = (rows.mapInArrow(count, "lang string, cell int, n bigint")
              .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows.select("lang").distinct().toPandas()["lang"])
    table = np.zeros((CELLS, len(langs)), np.float64)
    if langs:
        where = {x: k for k, x in enumerate(langs)}
        table[counts["cell"].to_numpy(np.int64), counts["lang"].map(where).to_numpy(np.int64)] \
            = counts["n"]
    log_p = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * CELLS))
    return Model(langs, log_p.astype(np.float32))


def _em(ll: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray):
    """Proportions and log-likelihood of each document over its allowed languages."""
    lp = np.where(allowed[doc], ll, -np.inf)
    top = lp.max(axis=1, keepdims=True)
    p = np.exp(lp - top)
    n = np.diff(np.append(first, len(doc)))[:, None]
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = theta[doc] * p
        r /= r.sum(axis=1, keepdims=True)
        theta = np.add.reduceat(r, first) / n
    fit_ll = np.log((theta[doc] * p).sum(axis=1)) + top[:, 0]
    return theta, np.add.reduceat(fit_ll, first)


def mixture(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Proportions of the selected languages (rows of zeros: no trigram or no model)."""
    n_docs, n_langs = len(offsets) - 1, len(model.langs)
    shares = np.zeros((n_docs, n_langs))
    sizes = np.diff(offsets)
    ids = np.flatnonzero(sizes > 0)
    if not n_langs or not len(ids):
        return shares
    if len(data) < 3:
        data = np.concatenate([data, np.full(3, 0x20, np.uint8)])
    cells = trigrams(data)
    # Segments by document; its last segment is shorter.  Trigrams that cross into the
    # next text are left out, but for texts of one or two bytes.
    used = np.maximum(sizes[ids] - 2, 1)
    per = -(-used // SEGMENT)
    doc = np.repeat(np.arange(len(ids)), per)
    first = np.cumsum(per) - per
    begin = np.minimum(offsets[ids][doc] + (np.arange(len(doc)) - first[doc]) * SEGMENT,
                       len(cells) - 1)
    end = np.minimum(offsets[ids] + used, len(cells))
    bounds = np.empty(2 * len(doc), np.int64)          # segment, then what lies before the next
    bounds[0::2] = begin
    bounds[1::2] = np.minimum(np.append(begin[1:], len(cells)), np.maximum(end[doc], begin + 1))
    rows = np.concatenate([model.log_p[cells], np.zeros((1, n_langs), np.float32)])
    ll = np.add.reduceat(rows, bounds)[0::2].astype(np.float64)

    total = np.add.reduceat(ll, first)
    best = total.argmax(axis=1)
    allowed = np.zeros((len(ids), n_langs), bool)
    allowed[np.arange(len(ids)), best] = True
    theta, fitted = allowed.astype(float), total.max(axis=1)
    penalty = PENALTY + np.log(per) / 2
    live = np.arange(len(ids))
    while len(live) and n_langs > 1:
        # What another language can add is bounded by its best segments.
        now = np.where(allowed[doc], ll, -np.inf).max(axis=1)
        bound = np.add.reduceat(np.maximum(ll - now[:, None], 0), first)
        slack = np.add.reduceat(now, first) - fitted
        can = ~allowed & (bound + slack[:, None] > penalty[:, None])
        gains = np.full((len(ids), n_langs), -np.inf)
        thetas = {}
        for x in range(n_langs):
            d = live[can[live, x]]
            if len(d):
                segments = np.concatenate([np.arange(first[k], first[k] + per[k]) for k in d])
                sub = np.repeat(np.arange(len(d)), per[d])
                grown = allowed[d].copy()
                grown[:, x] = True
                th, f = _em(ll[segments], sub, np.cumsum(per[d]) - per[d], grown)
                gains[d, x] = f - fitted[d] - penalty[d]
                thetas[x] = (d, th, f)
        choice = gains.argmax(axis=1)
        live = np.flatnonzero(gains.max(axis=1) > 0)
        for x, (d, th, f) in thetas.items():
            take = np.isin(d, live) & (choice[d] == x)
            allowed[d[take], x] = True
            theta[d[take]], fitted[d[take]] = th[take], f[take]
    shares[ids] = theta
    return shares


def predict(docs: DataFrame, model: Model, text_col: str = "text",
            names: tuple[str, str, str] = NAMES, min_share: float = 0.01) -> DataFrame:
    """``docs`` with lang_pred, score and shares (map of language to proportion, without
    proportions under ``min_share``)."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))
    schema = T.StructType(docs.schema.fields + [
        T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()),
        T.StructField(names[2], T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.names.index(text_col))
            data, offsets = flat(column)
            for i, j in chunks(offsets, CHUNK):
                part = batch.slice(i, j - i)
                found = mixture(m, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                letter = np.array([bool(t and _LETTER.search(t))
                                   for t in column.slice(i, j - i).to_pylist()])
                ok = letter & (found.sum(axis=1) > 0)
                top = found.argmax(axis=1) if m.langs else np.zeros(len(ok), np.int64)
                lang = [m.langs[t] if k else UNKNOWN for t, k in zip(top, ok, strict=True)]
                score = [min(1.0, float(found[r, t])) if ok[r] else 0.0
                         for r, t in enumerate(top)]
                shares = [[(m.langs[x], float(found[r, x])) for x in np.flatnonzero(found[r] >= min_share)]
                          if ok[r] else [] for r in range(len(ok))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                    names=[*part.schema.names, *names])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2
