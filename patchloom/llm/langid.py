"""Language identification by hyperdimensional profiles.

Every letter of Unicode has a random vector of +1 and -1, made from its code point by a seeded hash and
held as bits.  A letter trigram's vector binds (multiplies) the three letters' vectors, each permuted by
its place; a document's vector bundles (adds) those of its trigrams.  A language's prototype bundles the
unit vectors of its learning documents.  A document gets the language whose prototype has the largest
cosine with it; the score is that cosine, cut to [0, 1].

Text is lower-cased; runs of anything but letters are one blank.  The prototypes are learned from about
`per_language` documents of each language, chosen by a hash of the id.

Memory: a slice of texts is handled at once, its distinct trigrams per document in blocks, so a text
needs some 60 bytes for each of its own, whatever its script.

Edge cases: a null text or one without letters is `und` with score 0; equal texts get equal results;
null ids are held out; without learning rows every text is `und`; ties go to the smaller language code;
over MANY_LANGUAGES language codes are an error, since all prototypes are held at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, checkpoint, code_points, fold, mix64, slices, small_batches, text_bytes, word_spans

DIMENSIONS = 1024
#: Learning documents of a language, about.
PER_LANGUAGE = 3000
#: Languages at most: their counts are broadcast and their prototypes held by the driver.
MANY_LANGUAGES = 10_000
#: Distinct trigrams of a document whose vectors are held at once.
BLOCK = 4096
SEED = 11
UNKNOWN = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: the lower-case one, and whether it is a letter."""
    every = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in every], np.uint32)
    return lower, np.array([x.isalpha() for x in every])


def lower_letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters by code point, 0 for all else."""
    lower, alpha = cached("letters", _letters)
    low = np.minimum(points, 0xFFFF)
    out = np.where(alpha[low] & (points <= 0xFFFF), lower[low], 0)
    for c in np.unique(points[points > 0xFFFF]).tolist():
        if chr(c).isalpha():
            out[points == c] = ord(chr(c).lower())
    return out


def letter_bits(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of letters, a row each, as words of 64 bits (a bit is a -1); 0 stands for a blank."""
    words = np.arange(dimensions // 64, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(mix64(points.astype(np.uint64)[:, None] + np.uint64(SEED << 32)) + words[None, :])


def permuted(bits: np.ndarray, places: int) -> np.ndarray:
    """Coordinates moved round by `places` within each word."""
    return (bits << np.uint64(places)) | (bits >> np.uint64(64 - places)) if places else bits


def trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams by text: text index, the letters' indexes (three columns), counts; and the letters."""
    letters = lower_letters(points)
    starts, ends, n_words = word_spans(letters > 0, offsets)
    n_texts = len(n_words)
    text_of = np.repeat(np.arange(n_texts), n_words)
    # Each text is a blank and then its words, each with a blank behind it.
    length = ends - starts
    at = np.flatnonzero(letters)
    sequence = np.zeros(len(at) + len(starts) + n_texts, np.uint32)
    sequence[np.arange(len(at)) + np.repeat(np.arange(len(starts)) + text_of, length) + 1] = letters[at]
    per_text = np.bincount(text_of, length, minlength=n_texts).astype(np.int64) + n_words + 1
    owner = np.repeat(np.arange(n_texts), per_text)
    seen = np.unique(sequence)
    code, size = np.searchsorted(seen, sequence), len(seen)
    whole = owner[2:] == owner[:-2]
    # Fits in 63 bits: fewer than 2 ** 16 letters in a slice and 2 ** 15 texts in a batch.
    key = (((owner[:-2] * size + code[:-2]) * size + code[1:-1]) * size + code[2:])[whole]
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(key)))
    gram = key[first]
    return gram // size**3, np.column_stack([gram // size**2 % size, gram // size % size, gram % size]), counts, seen


def vectors(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vectors of some texts, a row each; zeros for a text without letters."""
    out = np.zeros((len(offsets) - 1, dimensions))
    points, at = code_points(data, offsets)
    if len(points) < 1:
        return out
    text, grams, counts, seen = trigrams(points, at)
    bits = letter_bits(seen, dimensions)
    placed = [permuted(bits, 2), permuted(bits, 1), bits]
    # Integers below 2 ** 24 stay exact in single precision, so a sum does not hang on its order.
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64
    edges = np.flatnonzero(np.diff(text, prepend=-1, append=len(out)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for s in range(a, b, BLOCK):
            g, n = grams[s : min(b, s + BLOCK)], counts[s : min(b, s + BLOCK)]
            bound = placed[0][g[:, 0]] ^ placed[1][g[:, 1]] ^ placed[2][g[:, 2]]
            ones = np.einsum("i,ij->j", n.astype(kind), np.unpackbits(bound.view(np.uint8), axis=1, bitorder="little").astype(kind))  # no threads of a BLAS
            out[text[a]] += n.sum() - 2.0 * ones
    return out


def unit_vectors(column: pa.Array, dimensions: int = DIMENSIONS):
    """Blocks of unit vectors of a column of texts, in order; a zero row for a text without letters."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        v = vectors(data, offsets[a : b + 1], dimensions)
        yield v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _bundle(dimensions: int):
    """For mapInArrow over (text, lang): the sum of the unit vectors by language."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for block in unit_vectors(batch.column("text"), dimensions):
                # Fixed point, so that sums do not hang on the order of rows.
                fixed = np.rint(block * (1 << 32)).astype(np.int64)
                for k, lang in enumerate(langs[at : at + len(block)]):
                    sums[lang] = sums[lang] + fixed[k] if lang in sums else fixed[k]
                at += len(block)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "total"])

    return run


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The language codes, sorted, and their unit prototypes."""
    able = small_batches(docs).select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (fold() != 1))
    share = checkpoint(able.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share")).limit(MANY_LANGUAGES + 1))
    if share.count() > MANY_LANGUAGES:
        raise ValueError(f"over {MANY_LANGUAGES} language codes")
    point = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lang")), 11) / float(1 << 53)
    chosen = able.join(F.broadcast(share), "lang").where(point < F.col("share")).select("text", "lang")
    # Sums by partition; a language's sums are added up place by place.
    parts = chosen.mapInArrow(_bundle(dimensions), "lang string, total array<long>")
    summed = parts.select("lang", F.posexplode("total").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda v: v["x"]).alias("v")).orderBy("lang").collect()
    rows = [r for r in rows if any(r["v"])]
    totals = np.array([r["v"] for r in rows], np.float64).reshape(-1, dimensions)
    return [r["lang"] for r in rows], totals / np.linalg.norm(totals, axis=1, keepdims=True) if rows else totals


def predict(column: pa.Array, langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and its cosine."""
    named, scores = [], []
    for block in unit_vectors(column, prototypes.shape[1]):
        cosines = np.round(block @ prototypes.T, 9) if langs else np.zeros((len(block), 1))
        some, best = block.any(axis=1) & bool(langs), cosines.argmax(axis=1)
        named += [langs[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)]
        scores.append(np.where(some, np.clip(cosines[np.arange(len(block)), best], 0, 1), 0.0))
    return named, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, prototypes = learn(docs, per_language, dimensions)

    def apply(batches):
        for batch in batches:
            named, scores = predict(batch.column("text"), langs, prototypes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold() == 1, F.lit(True)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")
