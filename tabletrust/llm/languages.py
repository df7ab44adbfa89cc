"""Language identification by multilingual mixtures of character trigrams.

Every language is a distribution over hashed trigrams of letters (other characters are one gap), learned from a bounded
sample of labelled texts. A text is a mixture: expectation-maximisation estimates the languages' proportions, and the
set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts a language's trigrams are counted on, about; larger languages are sampled by a hash of the id.
SAMPLE = 3_000
BUCKETS = 1 << 16
#: Rounds of expectation-maximisation: for a first look at all languages, and at most until proportions move less than MOVED.
STEPS, ROUNDS, MOVED = 8, 1000, 1e-4
#: Cost of one more language, in units of log(number of trigrams); trigrams overlap, so a third of the likelihood counts.
PENALTY = 3.0
GAP = 32


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around every letter; empty for a text without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[codes]
    codes = np.where(alpha, codes, np.uint32(GAP)).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48))[alpha[1:-1]].astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids].astype(np.float64)


def em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns of p) and the log likelihood. p: trigram by language; n: counts."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(rounds):
        joint = p * share
        before, share = share, (n / joint.sum(1)) @ joint / n.sum()
        if abs(share - before).max() < MOVED:
            break
    return share, float(n @ np.log(p @ share))


def identify(text: str | None, table: np.ndarray, names: list[str]) -> tuple[str, float, dict[str, float]]:
    """The main language, its proportion, and the proportions of the set of languages.

    The set grows from the best single language, by the one with the largest slope each time. The log likelihood is concave
    in the proportions, so no mixture gains more than the largest slope less the number of trigrams; the set stops growing
    when that bound can't pay for one more language, and the one with the best penalised likelihood on the way is taken. Then
    the languages with the least shares go as long as that raises the penalised likelihood.
    """
    if not text or not names:
        return "und", 0.0, {}
    ids, n = counted(text)
    if not len(ids):
        return "und", 0.0, {}
    p = table[ids].astype(np.float64)
    single, total = n @ np.log(p), n.sum()
    chosen, share = [int(single.argmax())], np.ones(1)
    cost, value = PENALTY * np.log(total + 1), single.max() / 3
    wide, part, fit = chosen, share, single.max()
    while len(wide) < len(names):
        slope = (n / (p[:, wide] @ part)) @ p
        if (fit + slope.max() - total) / 3 - len(wide) * cost <= value:
            break
        slope[wide] = -np.inf
        wide = [*wide, int(slope.argmax())]
        part, fit = em(p[:, wide], n)
        if fit / 3 - (len(wide) - 1) * cost > value:
            chosen, share, value = wide, part, fit / 3 - (len(wide) - 1) * cost
    while len(chosen) > 2:
        few = [x for i, x in enumerate(chosen) if i != share.argmin()]
        part, fit = em(p[:, few], n)
        if fit / 3 - (len(few) - 1) * cost <= value:
            break
        chosen, share, value = few, part, fit / 3 - (len(few) - 1) * cost
    top = int(share.argmax())
    score = share[top] if len(chosen) > 1 else em(p, n, STEPS)[0][chosen[0]]
    return names[chosen[top]], float(min(1.0, score)), {names[i]: float(x) for i, x in zip(chosen, share, strict=True)}
#: Parts of the hashes of ids, of which a sample takes some.
PARTS = 1 << 50


class LanguageModel:
    """Trigram distributions of the labelled languages; smoothing shares a little of all languages' counts."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        if names:
            prior = (counts.sum(1, keepdims=True) + 0.1) / (counts.sum() + 0.1 * BUCKETS)
            self.table = ((counts + 50 * prior) / (counts.sum(0) + 50)).astype(np.float32)
        else:
            self.table = np.ones((BUCKETS, 0), np.float32)


def share_of(sample: int, size: int) -> int:
    """How many of PARTS hold about `sample` of `size` rows: never none, however many rows there are."""
    return max(1, min(PARTS, PARTS * sample // size))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """labelled: doc_id, text, lang. Rows without text or language teach nothing; without any, every answer is und. Every
    language that occurs is learned; the model has BUCKETS numbers for each."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.ones((BUCKETS, 0)))
    limit = F.create_map(*(F.lit(x) for lang in names for x in (lang, share_of(sample, sizes[lang]))))
    taken = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < F.element_at(limit, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, n = counted(text)
                sums.setdefault(lang, np.zeros(BUCKETS))[ids] += n
        for lang, n in sums.items():
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(n[ids])], names=["lang", "id", "n"])

    found = taken.select("text", "lang").mapInArrow(count, "lang string, id int, n double").groupBy("lang", "id").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    counts = np.zeros((BUCKETS, len(names)))
    at = {name: i for i, name in enumerate(names)}
    counts[found["id"].to_numpy(), np.array([at[x] for x in found["lang"].to_pylist()], np.int64)] = found["n"].to_numpy()
    return LanguageModel(names, counts)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (proportion of that language) and mix (proportions of the set) for each row of docs.

    und with score 0 for texts that are null or have no letter. Only the text is read, whole at any length; languages that
    fit equally well go by name. Repeated rows and rows with equal or null ids are judged each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.names))  # BUCKETS numbers a language
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = shared.value
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                found = [identify(t, table, names) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64()), pa.array([list(r[2].items()) for r in found], kind)], names=["doc_id", "lang_pred", "score", "mix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mix map<string,double>")
