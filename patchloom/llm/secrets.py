"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every text is content-addressed (SHA-256).  A ledger holds (blob, rule_version, findings) of all that
has been scanned; a run scans only blobs that the ledger lacks at this rule version, once however many
paths hold them, appends them, and joins the findings back to all paths.

Match positions come from splitting a text at a rule: the pieces between matches and the matches
themselves add up to code-point offsets.

Edge cases: a null text is the empty text; null or repeated paths each keep a row; equal texts share
one scan; an empty table gives an empty result; columns beside the path and the text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Changes whenever a rule does, so that the ledger's old findings don't stand for new rules.
RULE_VERSION = "1"
#: Base kinds in their listed order: pattern, the group that counts, and its least length.
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: More kinds that the method adds, in well-known public formats.
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, 1),
)
#: A text without a match of the second pattern has no finding of the rule; it is cheaper to look for.
_HINT = {"assign": r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]", "hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}
#: A blob is hot if it has over one in so many paths, so there are fewer hot blobs than that.
HOT_BLOBS = 1000
#: Bytes of a hot blob's spans, at most, for its findings to be broadcast.
HOT_BYTES = 4096
_SPANS = "array<struct<start: int, k: int, kind: string, end: int>>"


def _parts(text: Column, kind: str, pattern: str, group: int) -> Column:
    """For each match of a rule: code points between the match before and it, of it, and of its group."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), F.arrays_zip(matches.alias("m"), groups.alias("g")), lambda p, x: F.struct(F.char_length(p).alias("gap"), F.char_length(x["m"]).alias("n"), F.char_length(x["g"]).alias("g")))
    return F.when(F.regexp_like(text, F.lit(_HINT.get(kind, pattern))), parts).otherwise(F.array().cast("array<struct<gap: int, n: int, g: int>>"))


def _spans(parts: Column, k: int, kind: str, least: int) -> Column:
    """The spans of a rule's leftmost non-overlapping matches whose group is long enough.

    A growing array is copied at each step, so n matches are added up in runs of about sqrt(n), whose
    spans then move by what lies before the run.
    """

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        span = F.struct(begin.alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).cast(_SPANS).alias("found"))

    def move(state: Column, run: Column) -> Column:
        moved = F.transform(run["found"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["k"].alias("k"), s["kind"].alias("kind"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["found"], F.array(moved)).cast(f"array<{_SPANS}>").alias("found"))

    width = F.ceil(F.sqrt(F.greatest(F.size(parts), F.lit(1)))).cast("int")
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), width), lambda c: F.aggregate(F.slice(parts, c + 1, width), none, step))
    found = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("found")), move, lambda s: F.flatten(s["found"]))
    return F.when(F.size(parts) > 0, found).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    """kind:start:end by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, rule_version and findings of the texts in (blob, text)."""
    rules = [*BASE_RULES, *MORE_RULES]
    matched = blobs.select("blob", *(_parts(F.col("text"), kind, pattern, group).alias(f"p{k}") for k, (kind, pattern, group, _) in enumerate(rules)))
    found = matched.select("blob", *(_spans(F.col(f"p{k}"), k, kind, least).alias(f"s{k}") for k, (kind, _, _, least) in enumerate(rules)))
    base = F.concat(*(F.col(f"s{k}") for k in range(len(BASE_RULES))))
    every = F.concat(*(F.col(f"s{k}") for k in range(len(rules))))
    counts = [F.size(f"s{k}").cast("long").alias(f"n_{r[0]}") for k, r in enumerate(BASE_RULES)]
    return found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))


def addressed(files: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob (SHA-256 of the text) and text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return files.select(F.col(path).alias("path"), F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("text"))


def by_path(places: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings (one row a blob) of every row of `places` (path, blob), without a task for a hot blob.

    Hot blobs with short spans are broadcast, fewer than HOT_BLOBS rows of about HOT_BYTES; the others
    are joined by shuffle, where adaptive execution splits what is still skewed.
    """
    total = places.count()
    hot = places.groupBy("blob").count().where(F.col("count") * HOT_BLOBS > total).select("blob")
    light = checkpoint(findings.where(F.octet_length("spans") <= HOT_BYTES).join(F.broadcast(hot), "blob", "left_semi"))
    rest = places.join(F.broadcast(light.select("blob")), "blob", "left_anti").join(findings, "blob")
    return places.join(F.broadcast(light), "blob").unionByName(rest)


def scan(versions: list[DataFrame], ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by path, ledger entries that are new) of every historical version in `versions`.

    A blob that `ledger` holds at RULE_VERSION is not scanned again; the caller appends the new entries.
    """
    files = reduce(DataFrame.unionByName, (addressed(v, path, text) for v in versions))
    # One row a blob: copies fall away in the map-side half of the aggregation.
    blobs = files.dropDuplicates(["blob"]).select("blob", "text")
    known = None if ledger is None else ledger.where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])
    new = checkpoint(scan_blobs(blobs if known is None else blobs.join(known.select("blob"), "blob", "left_anti")))
    every = new if known is None else known.select(*new.columns).unionByName(new)
    return by_path(checkpoint(files.select("path", "blob")), every), new


def scan_with_ledger(files: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings by path; what is new is appended to the Parquet ledger at `ledger_path` first."""
    spark = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    _, new = scan([files], spark.read.parquet(ledger_path) if there else None, path, text)
    new.write.mode("append").parquet(ledger_path)
    found, _ = scan([files], spark.read.parquet(ledger_path), path, text)
    return found
