"""Mixing weights from soft domain membership.

A classifier learned from a labelled table gives every document its domain posteriors p. Rates r >= 0 for the
documents are then fitted so that the expected token totals of the domains, the sums of r * tokens * p, match targets:
accelerated projected gradient on the scaled least squares, with a small pull towards rate 1 that makes the answer
unique. Each iteration is one pass over the narrow table of posteriors that adds up one number a domain; the rates
themselves are not stored but follow from the posteriors and the past gradients, a list of short vectors. So nothing of
the documents' size reaches the driver, no lineage builds up, and a lost task is simply run again. It ends when the
totals are within ``TOLERANCE`` of all tokens, or when the projected gradient is below ``GRADIENT``: then the targets
cannot be met and the rates are the nearest ones. Momentum starts anew where it points uphill. Wanted and reached totals
are logged for each domain, with a warning where they differ by more than ``TOLERANCE`` of all tokens.

The classifier learns from at most ``SAMPLE`` labelled rows (those with the smallest hash of their id); posteriors,
totals and rates cover all documents. It looks at the statistics of ``features`` and, for each domain, at the words
that mark it (the mean of the three largest log-odds among a text's words, hashed to ``2**WORD_BITS`` buckets).

Cases: null and empty texts have no tokens and get the posterior of an empty text; labels of unknown documents and
null labels are ignored; several labels of one document: the smallest domain counts; with fewer than two labelled
domains, or without tokens, all rates are 1; targets of domains that no labelled row has are left out, and a domain
without a target raises; repeated rows each get a rate; an empty table gives no rows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.features import NAMES, text_features
from pulseframe.llm.qda_quality import Discriminant, fit, moments
from pulseframe.llm.run import emit_rows, map_texts, quoted, ready, stream
from pulseframe.llm.text import Block, Words
from pulseframe.session import materialize

SAMPLE = 20_000
WORD_BITS = 18
PRIOR = 20.0
TOP_WORDS = 3
PULL = 1e-3
TOLERANCE = 1e-4
GRADIENT = 1e-5
TEMPERATURE = 2.0
_log = logging.getLogger(__name__)


def labelled_sample(labels: DataFrame, domain, doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``__id`` and ``__domain`` (string) of at most ``sample`` labelled documents."""
    rows = (labels.select(F.col(quoted(doc_id)).alias("__id"), domain.cast("string").alias("__domain"))
            .dropna().groupBy("__id").agg(F.min("__domain").alias("__domain")))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(sample)


def _word_buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, and where each text starts among them; words are lower-cased."""
    words = Words(block.lowered())
    bucket = (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    tagged = np.unique((words.doc() << WORD_BITS) | bucket)
    return tagged & ((1 << WORD_BITS) - 1), np.searchsorted(tagged >> WORD_BITS, np.arange(len(block) + 1))


def word_odds(sample_docs: DataFrame, domains: list[str], text: str) -> np.ndarray:
    """Log-odds of each word bucket for each domain against the others, from document counts of the sample."""

    def count(block: Block, key: pa.Array) -> dict:
        bucket, first = _word_buckets(block)
        number = key.to_numpy(zero_copy_only=False)
        many = np.diff(first)
        cell = np.repeat(number, many) * (1 << WORD_BITS) + bucket
        cell, n = np.unique(cell, return_counts=True)
        own, docs_of = np.unique(number, return_counts=True)
        return {"cell": np.append(cell, -1 - own), "n": np.append(n, docs_of)}

    counted = (emit_rows(sample_docs, count, "cell long, n long", "__number", text)
               .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # at most domains * 2**WORD_BITS rows
    cell, n = counted["cell"].to_numpy(), counted["n"].to_numpy()
    size = np.zeros(len(domains))
    size[-1 - cell[cell < 0]] = n[cell < 0]
    held = np.zeros(len(domains) << WORD_BITS)
    held[cell[cell >= 0]] = n[cell >= 0]
    held = held.reshape(len(domains), -1)
    total, everyone = held.sum(axis=0), max(size.sum(), 1)
    out = np.empty_like(held)
    for k in range(len(domains)):
        own, rest = size[k], everyone - size[k]
        out[k] = (np.log((held[k] + PRIOR * own / everyone + 1e-9) / (own + PRIOR))
                  - np.log((total - held[k] + PRIOR * rest / everyone + 1e-9) / (rest + PRIOR)))
    return out.astype(np.float32)


@dataclass
class DomainModel:
    domains: list[str]
    odds: np.ndarray
    discriminant: Discriminant | None = None

    def rows(self, block: Block) -> np.ndarray:
        bucket, first = _word_buckets(block)
        marks = np.zeros((len(block), len(self.domains)))
        for k, odds in enumerate(self.odds):
            marks[:, k] = _top_mean(odds[bucket], first)
        return np.column_stack([text_features(block), marks])

    def posteriors(self, block: Block) -> np.ndarray:
        if self.discriminant is None:
            return np.full((len(block), len(self.domains)), 1 / max(1, len(self.domains)))
        return self.discriminant.posteriors(self.rows(block), TEMPERATURE)


def _top_mean(values: np.ndarray, first: np.ndarray, top: int = TOP_WORDS) -> np.ndarray:
    """Mean of the largest values of each text; 0 for a text without any."""
    values = values.astype(np.float64)
    sums, taken = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first) > 0)
    for _ in range(top):
        if not len(some):
            break
        best = np.maximum.reduceat(values, first[some])
        real = best > -np.inf
        sums[some[real]] += best[real]
        taken[some[real]] += 1
        owner = np.repeat(np.arange(len(some)), np.diff(first)[some])
        hit = np.flatnonzero(values == best[owner])
        _, one = np.unique(owner[hit], return_index=True)
        values[hit[one]] = -np.inf
    return sums / np.maximum(taken, 1)


def learn_domains(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DomainModel:
    spark = ready(docs)
    sample = materialize(sample, "labelled-sample")
    texts = materialize(
        docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).alias("__text_of"))
        .join(F.broadcast(sample), "__id").select("__domain", F.col("__text_of").alias("text")),
        "labelled-texts")  # at most SAMPLE texts, unless rows repeat
    domains = sorted(r[0] for r in texts.select("__domain").distinct().collect())  # those that documents have
    if len(domains) < 2:
        return DomainModel(domains, np.zeros((len(domains), 1 << WORD_BITS), np.float32))
    number = F.array_position(F.lit(domains), F.col("__domain")).cast("int") - 1
    picked = texts.select(number.alias("__number"), "text")
    model = DomainModel(domains, word_odds(picked, domains, "text"))
    held = spark.sparkContext.broadcast(model)

    def compute(block: Block) -> dict:
        rows = held.value.rows(block)
        return {"features": _lists(rows)}

    rows = map_texts(picked, compute, "features array<double>", ["__number"], "text")
    found = moments(rows.select("features", F.col("__number").alias("class")), len(NAMES) + len(domains))
    made = fit(found)
    if made is not None:
        model.domains = [domains[c] for c in made.classes]
        model.odds = model.odds[made.classes] if len(made.classes) < len(domains) else model.odds
        if len(made.classes) == len(domains):
            model.discriminant = made
    return model


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]),
                                    pa.array(rows.ravel()))


@dataclass
class Rates:
    """Past gradients, and after which of them momentum starts anew; a document's rate follows from its posteriors."""

    pull: float = 0.0
    gradients: list[np.ndarray] = field(default_factory=list)
    anew: list[bool] = field(default_factory=list)

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rates after the last step, the point at which the next gradient is taken, and of the last step how far
        it went and how far it went against the momentum."""
        rate = point = np.ones(len(p))
        moved = against = np.zeros(len(p))
        t = 1.0
        for gradient, anew in zip(self.gradients, self.anew, strict=True):
            new = np.maximum(0.0, point - p @ gradient - self.pull * (point - 1))
            moved, against = np.abs(new - point), (point - new) * (new - rate)
            t_next = 1.0 if anew else (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = 0.0 if anew else (t - 1) / t_next
            rate, point, t = new, new + ahead * (new - rate), t_next
        return rate, point, moved, against


def _totals(members: DataFrame, size: int, cells: int, add) -> np.ndarray:
    """Sums of ``add(tokens, posteriors)`` over all documents; one row a task goes to the driver's sum."""
    names = [f"c{k}" for k in range(cells)]

    def run(batches):
        sums = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                p = np.asarray(batch.column(1).flatten()).reshape(-1, size)
                sums += add(batch.column(0).to_numpy(), p)
        yield {name: [value] for name, value in zip(names, sums, strict=True)}

    row = (stream(members.select("n_tokens", "posteriors"), run, ", ".join(f"{c} double" for c in names))
           .agg(*(F.sum(c).alias(c) for c in names)).first())
    return np.array([value or 0.0 for value in row])


def fit_rates(members: DataFrame, targets: np.ndarray, tolerance: float = TOLERANCE, gradient: float = GRADIENT,
              pull: float = PULL) -> tuple[Rates, np.ndarray, np.ndarray]:
    """Rates for ``members`` (``n_tokens``, ``posteriors``) whose domain totals match the targets (shares of all
    tokens); also the targets in tokens and the totals reached."""
    size = len(targets)
    gram = _totals(members, size, size * size, lambda tokens, p: ((p * tokens[:, None]).T @ p).ravel()).reshape(size, size)
    tokens = gram.sum()
    if not tokens:
        return Rates(), targets * 0, targets * 0
    wanted = targets / targets.sum() * tokens
    scale = 1 / np.maximum(tokens * np.diag(gram), 1e-12)
    root = np.sqrt(scale)
    bound = np.linalg.eigvalsh(tokens * gram * np.outer(root, root)).max() + pull
    rates = Rates(pull / bound)

    def step(many, p):
        _, point, moved, against = rates.replay(p)
        return np.append((point * many) @ p, [many @ moved, many @ against])

    while True:
        *reached, moved, against = _totals(members, size, size + 2, step)
        missed = np.array(reached) - wanted
        if rates.gradients and against > 0 and not rates.anew[-1]:
            rates.anew[-1] = True  # the totals are added up again without the momentum
            continue
        if rates.gradients and moved * bound <= gradient * tokens:
            break
        rates.gradients.append(tokens * scale * missed / bound)
        rates.anew.append(False)
        if np.abs(missed).max() <= tolerance * tokens:
            break
    return rates, wanted, _totals(members, size, size, lambda many, p: (rates.replay(p)[0] * many) @ p)


def domain_rates(docs: DataFrame, labels: DataFrame, domain, targets: dict[str, float], doc_id: str = "doc_id",
                 text: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, DomainModel, Rates]:
    """Per document ``n_tokens`` (words), ``posteriors`` (in the model's order of domains) and ``rate``."""
    model, members, rates = _fitted(docs, labels, domain, targets, doc_id, text, sample)

    def rate(batches):
        for batch in batches:
            p = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.replay(p)[0])],
                                             names=[*batch.schema.names, "rate"])

    kind = members.schema[doc_id].dataType.simpleString()
    schema = f"{quoted(doc_id)} {kind}, n_tokens long, posteriors array<double>, rate double"
    return members.mapInArrow(rate, schema), model, rates


def _fitted(docs, labels, domain, targets, doc_id, text, sample):
    spark = ready(docs)
    model = learn_domains(docs, labelled_sample(labels, domain, doc_id, sample), doc_id, text)
    held = spark.sparkContext.broadcast(model)

    def score(block: Block) -> dict:
        return {"n_tokens": Words(block).counts(), "posteriors": _lists(held.value.posteriors(block))}

    members = materialize(map_texts(docs, score, "n_tokens long, posteriors array<double>", [doc_id], text),
                          "domain-posteriors")
    aimless = [d for d in model.domains if d not in targets]
    if aimless:
        raise ValueError(f"domains without a target: {aimless}; give 0 for none of their tokens")
    goal = np.array([targets[d] for d in model.domains], dtype=float)
    if model.discriminant is None or not goal.sum():
        return model, members, Rates()
    rates, wanted, reached = fit_rates(members, goal)
    _report(model.domains, wanted, reached, len(rates.gradients))
    return model, members, rates


def _report(domains: list[str], wanted: np.ndarray, reached: np.ndarray, passes: int) -> None:
    for name, want, have in zip(domains, wanted, reached, strict=True):
        missed = abs(have - want) > TOLERANCE * wanted.sum()
        _log.log(logging.WARNING if missed else logging.INFO,
                 "domain %s: wanted %.1f tokens, reached %.1f, residual %.1f, after %d passes", name, want, have,
                 have - want, passes)


def mix(docs: DataFrame, labels: DataFrame, domain, targets: dict[str, float], doc_id: str = "doc_id",
        text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the rest as probability, decided
    by a hash of its id and text. All columns are kept; the texts are not shuffled."""
    spark = ready(docs)
    model, _, rates = _fitted(docs, labels, domain, targets, doc_id, text, sample)
    held = spark.sparkContext.broadcast((model, rates))
    names = docs.columns

    def rate(block: Block) -> dict:
        found, fitted = held.value
        return {"__rate": fitted.replay(found.posteriors(block))[0]}

    chance = F.pmod(F.xxhash64(quoted(doc_id), quoted(text)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("__rate").cast("int")
    copies = whole + (chance < F.col("__rate") - whole).cast("int")
    return (map_texts(docs, rate, "__rate double", names, text)
            .withColumn("__copies", copies).filter(F.col("__copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[quoted(c) for c in names]))
