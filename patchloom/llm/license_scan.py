"""License scans in DataFrame functions alone: TF-IDF cosine to templates, then directory inheritance.

The templates are whole licences, standard headers, titles and one-line notices (license_texts).  Term
weights are (1 + ln tf) * idf, the idf taken from the templates alone, so that a verdict hangs on the text and not
on the corpus around it; a term of no template has the largest idf.

The units of a file are, after comment signs are taken off its lines: lines, paragraphs (runs of lines
that are not blank) and passages (runs of paragraphs), of which each paragraph or line holds one of WORDS,
the language of licences that every paragraph of the templates speaks; and the whole text of a
file with a licence's name.  So a wrapped header is one unit, and so is a licence of several clauses,
wherever in the text they stand.  A unit gets the template with the largest cosine, from THRESHOLD on, or
SHORT_THRESHOLD for a template of under SHORT terms.  A file has the licence of its best unit; a reservation of
all rights yields to any grant.

A licence file - by its name, or because one licence unit holds nine tenths of its
words - also speaks for its directory; a file without a licence of its own inherits from the nearest
ancestor directory that has one, by a join of directory paths.

Edge cases: a null or empty text has no unit; a null path is no directory and inherits nothing; ties
go to the longer unit, then to the smaller template (in the order of TEMPLATES); repeated rows keep a row each; equal
units are compared once; an empty table gives an empty result; columns beside the path and the text
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, checkpoint, left_join_hot
from .license_texts import TEMPLATES

THRESHOLD, SHORT_THRESHOLD, SHORT = 0.6, 0.75, 8
#: What lines and paragraphs that speak of a licence hold.
WORDS = r"(?i)\b(?:licen[cs]|sublicens|copyright|copyleft|spdx|warrant|public domain|creative commons|cc0|rights reserved|redistribut|permission|permitted|liab|merchantab|infring|endorse|unencumbered|unlicense|mozilla|apache|gnu|a?l?gpl|bsd|software)"
#: Names of licence files.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|copyright|notice)([-_.][^/]*)?$"
#: Comment signs and blanks at either end of a line.
SIGNS = r"^[\s#/*;%!<>-]+|[\s#/*;%!<>-]+$"
#: The licence that any other beats.
RESERVED = "proprietary"
#: Units whose verdicts may be broadcast.
MANY_UNITS = 200_000


def terms(text: Column) -> Column:
    """Lower-case terms; a dot stays inside (4.0), not at an end."""
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.]+"), lambda w: F.trim(w, F.lit(".")))
    return F.filter(words, lambda w: w != "")


def weigh(templates: tuple) -> tuple[list, list, float]:
    """(term, idf), (template, license, term, weight, norm, threshold) and the idf of all other terms."""
    counts = [Counter(w.strip(".") for w in re.split(r"[^a-z0-9.]+", text.lower()) if w.strip(".")) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / n) for t, n in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(k, name, t, w, norm, SHORT_THRESHOLD if len(c) < SHORT else THRESHOLD) for t, w in weights.items()]
    return list(idf.items()), rows, math.log(1 + len(templates))


def units_of(files: DataFrame) -> DataFrame:
    """path, h, text -> one row per unit: path, h, n_words (of the text), unit (its terms, blank-joined) and unit_words."""
    speaks = lambda x: F.regexp_like(x, F.lit(WORDS))
    named = F.regexp_like(F.coalesce("path", F.lit("")), F.lit(LICENSE_FILE))
    some = files.where(F.col("text").isNotNull() & (speaks(F.col("text")) | named))
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(x, SIGNS, ""))
    cut = some.select("path", "h", "text", named.alias("named"), lines.alias("lines"))
    cut = cut.withColumn("paragraphs", F.split(F.array_join("lines", "\n"), r"\n(?:[ ]*\n)+"))
    # A paragraph that speaks of no licence ends a passage: it becomes a mark at which the joined text is cut.
    marked = F.array_join(F.transform("paragraphs", lambda x: F.when(speaks(x), F.replace(x, F.lit("\u0001"), F.lit(" "))).otherwise(F.lit("\u0001"))), "\n")
    units = F.concat(F.filter("lines", speaks), F.filter("paragraphs", speaks), F.filter(F.split(marked, "\u0001"), speaks), F.when(F.col("named"), F.array("text")).otherwise(F.array().cast("array<string>")))
    blanks = lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    exploded = cut.select("path", "h", blanks(F.col("text")).alias("n_words"), F.explode(F.array_distinct(units)).alias("u"))
    made = exploded.select("path", "h", "n_words", F.array_join(terms(F.col("u")), " ").alias("unit"), blanks(F.col("u")).alias("unit_words"))
    return made.where("unit <> ''").groupBy("path", "h", "n_words", "unit").agg(F.max("unit_words").alias("unit_words"))


def match_units(units: DataFrame, templates: tuple = TEMPLATES, threshold: float | None = None) -> DataFrame:
    """uid (hash of the unit), license, score and template of every distinct unit that matches one."""
    spark: SparkSession = units.sparkSession
    idf, weights, unknown = weigh(templates)
    given = spark.createDataFrame(weights, "template int, license string, term string, wt double, norm double, least double")
    known = spark.createDataFrame(idf, "term string, idf double")
    # All that follows stays in the partitions by uid; the fixed templates' terms are broadcast.
    distinct = units.select(F.xxhash64("unit").alias("uid"), "unit").groupBy("uid").agg(F.min("unit").alias("unit"))
    of_unit = distinct.select("uid", F.explode(F.split("unit", " ")).alias("term")).groupBy("uid", "term").agg(F.count("*").alias("tf"))
    weighed = of_unit.join(F.broadcast(known), "term", "left").select("uid", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown))).alias("w"))
    lengths = weighed.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("nu"))
    dots = weighed.join(F.broadcast(given), "term").groupBy("uid", "template", "license", "norm", "least").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"))
    scored = dots.join(lengths, "uid").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("nu")), 6))
    enough = F.col("score") >= (F.col("least") if threshold is None else F.lit(threshold))
    best = scored.where(enough).groupBy("uid").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select("uid", F.col("b.license").alias("license"), F.col("b.score").alias("score"), (-F.col("b.t")).alias("template"))


def directory(path: Column) -> Column:
    """The path without its last part; null for a null path."""
    return F.regexp_replace(path, r"/*[^/]*/*$", "")


def ancestors(path: Column) -> Column:
    """A directory and all above it, as an array of (dir, depth); the root is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above"), n.alias("depth")))


def license_scan(files: DataFrame, path: str = "path", text: str = "text", templates: tuple = TEMPLATES, threshold: float | None = None) -> DataFrame:
    """path, own_license, score, inherited_license, inherited_from and license of every file."""
    own = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    units = checkpoint(units_of(own).withColumn("uid", F.xxhash64("unit")))  # the texts are read once for it
    verdicts, _ = broadcast_below(checkpoint(match_units(units, templates, threshold)), MANY_UNITS)
    matched = units.select("path", "h", "n_words", "unit_words", "uid").join(verdicts, "uid")
    # "All rights reserved" also stands above grants, so it counts only where nothing else is said.
    order = F.struct((F.col("license") != RESERVED).alias("grants"), "score", "unit_words", (-F.col("template")).alias("t"), "license")
    per_file = matched.groupBy("path", "h").agg(F.max(order).alias("b"), F.max("unit_words").alias("licence_words"), F.max("n_words").alias("n_words"))
    named = F.regexp_like(F.coalesce("path", F.lit("")), F.lit(LICENSE_FILE)) | (F.col("licence_words") * 10 >= F.col("n_words") * 9)
    per_file = per_file.select("path", "h", F.col("b.license").alias("own_license"), F.col("b.score").alias("score"), named.alias("speaks"))
    speaking = per_file.where(F.col("speaks") & F.col("path").isNotNull()).select(directory(F.col("path")).alias("above"), F.struct("score", "own_license").alias("s"))
    of_dir = speaking.groupBy("above").agg(F.max("s").alias("s")).select("above", F.col("s.own_license").alias("dir_license"))
    # Directories, not files, look for their nearest licence.
    files_of = checkpoint(own.select(directory(F.col("path")).alias("dir")).groupBy("dir").count())
    dirs = files_of.where("dir is not null").select("dir")
    nearest = dirs.select("dir", F.inline(ancestors(F.col("dir")))).join(of_dir, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("d"))
    inherited = checkpoint(nearest.select("dir", F.col("d.dir_license").alias("inherited_license"), F.col("d.above").alias("inherited_from")))
    every = own.select("path", "h", directory(F.col("path")).alias("dir"))
    found = per_file.select(F.col("path").alias("_path"), F.col("h").alias("_h"), "own_license", "score")
    known = every.join(found, (F.col("h") == F.col("_h")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    total = files_of.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    joined = left_join_hot(known, inherited, "dir", total, files_of, F.xxhash64("path", "h"))
    return joined.select("path", "own_license", "score", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))
