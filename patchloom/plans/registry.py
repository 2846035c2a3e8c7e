"""The registered queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import SIGN, checkpoint, hex16, shared_folder
from ..operators import bitset, cover, index, ingest, stats
from ..sources import patchfile, statsfile, synthetic

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Instance:
    """Patches and elements of a table, as Spark and as DuckDB expressions."""

    table: str
    patch: str
    element: str
    sql_element: str | None = None


INSTANCES = {
    "suppliers_parts": Instance("lineitem", "l_suppkey", "l_partkey"),
    "parts_suppliers": Instance("lineitem", "l_partkey", "l_suppkey"),
    "orders_parts": Instance("lineitem", "l_orderkey", "l_partkey"),
    "users_hours": Instance("events", "user_id", "unix_timestamp(ts) div 3600", "CAST(floor(epoch(ts)) AS BIGINT) // 3600"),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str, name: str = "suppliers_parts") -> DataFrame:
    """Occurrences of an instance; those of lineitem are at (l_extendedprice, l_quantity)."""
    if name == "customers_parts":
        rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return ingest.from_table(rows, "o_custkey", "l_partkey", "l_extendedprice", "l_quantity")
    if name == "documents_words":
        words = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
        return ingest.from_table(words, "doc_id", F.xxhash64("word"))
    i = INSTANCES[name]
    place = ("l_extendedprice", "l_quantity") if i.table == "lineitem" else (None, None)
    return ingest.from_table(_read(spark, sf_dir, i.table), F.col(i.patch), F.expr(i.element), *place)


def incidences(spark: SparkSession, sf_dir: str, name: str = "suppliers_parts") -> DataFrame:
    return ingest.incidence(occurrences(spark, sf_dir, name))


INC = "SELECT DISTINCT l_suppkey AS patch_id, l_partkey AS hash FROM lineitem"
DICT = f"SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS element_id FROM (SELECT DISTINCT hash FROM ({INC}))"
ENC = f"SELECT patch_id, element_id FROM ({INC}) JOIN ({DICT}) USING (hash)"
STATS = "SELECT l_partkey AS hash, count(DISTINCT l_suppkey) AS n_patches, min({'x': l_extendedprice, 'y': l_quantity}) AS rep FROM lineitem GROUP BY 1"
TOP = 100
FIRST = "SELECT DISTINCT patch_id FROM ({inc}) WHERE patch_id <= 3"
SHARDS = 7
#: The unsigned value of a hash that has its highest bit set if odd.
HIGH = "CASE WHEN hash % 2 = 1 THEN CAST(hash AS UBIGINT) + 9223372036854775808::UBIGINT ELSE CAST(hash AS UBIGINT) END"


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.encode(incidences(spark, sf_dir))


def _first_three(rows: DataFrame) -> DataFrame:
    return rows.select("patch_id").where("patch_id <= 3").distinct()


def patch_csr(spark, sf_dir):
    return index.patch_csr(_encoded(spark, sf_dir)).select("patch_id", _joined("elements").alias("elements"))


def inverted_index(spark, sf_dir):
    return index.inverted_index(_encoded(spark, sf_dir)).select("element_id", _joined("patches").alias("patches"))


def dictionary_encode(spark, sf_dir):
    return index.dictionary(incidences(spark, sf_dir))


def reverse_map(spark, sf_dir):
    words = index.dictionary(incidences(spark, sf_dir))
    return index.reverse_map(words, words.select("element_id"))


def patches_of(spark, sf_dir):
    """Every element, and one past the end, which no patch holds."""
    encoded = _encoded(spark, sf_dir)
    ids = encoded.select("element_id").distinct()
    wanted = ids.union(ids.agg(F.max("element_id") + 1))
    found = index.patches_of(index.inverted_index(encoded), wanted)
    return found.select("element_id", _joined("patches").alias("patches"), F.size("patches").cast("long").alias("n"))


def patch_lookup(spark, sf_dir):
    """Every patch, and one that does not exist."""
    encoded = _encoded(spark, sf_dir)
    ids = encoded.select("patch_id").distinct()
    wanted = ids.union(ids.agg(F.max("patch_id") + 1))
    return index.patch_lookup(index.patch_csr(encoded), wanted).select("patch_id", "size")


def sub_csr(spark, sf_dir):
    """The rows of each shard's part of the matrix, with ids local to the shard."""
    patches = index.PatchSet(occurrences(spark, sf_dir))
    return index.sub_csr(patches.encoded, patches.n, SHARDS).select("shard", "patch_id", _joined("elements").alias("elements"))


def longest_rows(spark, sf_dir):
    patches = index.PatchSet(occurrences(spark, sf_dir))
    return index.longest_rows(patches.encoded, patches.n, SHARDS)


def sorted_rows(spark, sf_dir):
    return index.sorted_rows(_encoded(spark, sf_dir), "element_id")


def _high_hashes(spark, sf_dir):
    """Occurrences whose hashes lie on both sides of 2 ** 63: odd parts have the highest bit set."""
    return occurrences(spark, sf_dir).withColumn("hash", F.when(F.col("hash") % 2 == 1, F.col("hash").bitwiseXOR(F.lit(SIGN))).otherwise(F.col("hash")))


def dictionary_unsigned(spark, sf_dir):
    return index.dictionary(ingest.incidence(_high_hashes(spark, sf_dir))).select(hex16("hash").alias("hash"), "element_id")


def hash_stats_topk_unsigned(spark, sf_dir):
    top = stats.top_k(stats.hash_stats(_high_hashes(spark, sf_dir)), TOP)
    return top.select(hex16("hash").alias("hash"), "n_patches", "rep.x", "rep.y")


def hash_stats_all(spark, sf_dir):
    return stats.hash_stats(stats.require_locations(occurrences(spark, sf_dir))).select("hash", "n_patches", "rep.x", "rep.y")


def hash_stats_topk(spark, sf_dir):
    return stats.top_k(stats.hash_stats(occurrences(spark, sf_dir)), TOP).select("hash", "n_patches", "rep.x", "rep.y")


def stats_records(spark, sf_dir):
    return statsfile.records(stats.hash_stats(occurrences(spark, sf_dir)))


def newly_covered(spark, sf_dir):
    rows = incidences(spark, sf_dir)
    return cover.newly_covered(rows, 4, _first_three(rows))


def covered_union(spark, sf_dir):
    """The union of the bitmaps of patches 1 to 3, as ids."""
    encoded = _encoded(spark, sf_dir)
    return bitset.members(bitset.union(bitset.build(encoded.where("patch_id <= 3"), ["patch_id"])))


def bitset_popcount(spark, sf_dir):
    return bitset.popcount(bitset.build(_encoded(spark, sf_dir), ["patch_id"]), ["patch_id"])


def bitset_members(spark, sf_dir):
    return bitset.members(bitset.build(_encoded(spark, sf_dir), ["patch_id"]), ["patch_id"])


def bitset_test(spark, sf_dir):
    encoded = _encoded(spark, sf_dir)
    return bitset.test(bitset.build(encoded.where("patch_id = 1")), encoded.select("element_id").distinct())


def bitset_members_ascending(spark, sf_dir):
    """The ids of all patches' bitmaps, numbered in the order in which they are enumerated."""
    found = bitset.members(bitset.build(_encoded(spark, sf_dir), ["patch_id"]), ["patch_id"], ascending=True)
    return ingest.dense(checkpoint(found), "place")


def bitset_and_count(spark, sf_dir):
    """Bits set in the bitmaps of patch 1 and of patch 2."""
    encoded = _encoded(spark, sf_dir)
    one, two = (bitset.build(encoded.where(F.col("patch_id") == p)) for p in (1, 2))
    return bitset.popcount(bitset.intersect(one, two))


def intersect_count(spark, sf_dir):
    rows = incidences(spark, sf_dir)
    return bitset.intersect_count(rows.where("patch_id = 1"), rows.where("patch_id = 2"), "hash")


def gain_after_k(spark, sf_dir):
    rows = incidences(spark, sf_dir)
    return cover.gains_after(rows, _first_three(rows))


def best_patch(spark, sf_dir):
    return cover.best_patch(gain_after_k(spark, sf_dir))


def contiguous_slice(spark, sf_dir):
    """Orders, numbered from 0 as patches are, in SHARDS contiguous parts."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"))
    numbered = index.dictionary(orders).select(F.col("element_id").alias("patch_id"))
    return ingest.contiguous_slice(numbered, numbered.agg(F.count("*")).first()[0], SHARDS)


def element_shard(spark, sf_dir):
    return index.element_shard(index.dictionary(incidences(spark, sf_dir)), SHARDS)


def cover_summary(spark, sf_dir):
    return cover.summary(cover.cover_lazy(incidences(spark, sf_dir, "orders_parts")))


def cover_grouped(spark, sf_dir):
    """A cover of parts by suppliers for each ship year."""
    rows = _read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), F.col("l_suppkey").alias("patch_id"), F.col("l_partkey").alias("hash"))
    return cover.cover_grouped(rows, "year")


#: Patch ids that are broadcast with their places.
BROADCAST_IDS = 200_000


def patch_file_round_trip(spark, sf_dir):
    """Written as a patch file with locations and read again.

    The patches of a file are its places from 0.  Suppliers that count so are their own places; others go through a
    table of places.  Within a patch the file follows hash, x and y, so it does not hang on how the table is parted.
    """
    rows = ingest.validate(occurrences(spark, sf_dir))
    ids = rows.select("patch_id").distinct()
    low, high, n, known = ids.agg(F.min("patch_id"), F.max("patch_id"), F.count("*"), F.count("patch_id")).first()
    if known < n:  # the join below would drop it
        raise ValueError("a patch id or a hash is null")
    places = None if not n or (low, high) == (0, n - 1) else ingest.places(ids)
    if places is not None:
        places = F.broadcast(places) if n <= BROADCAST_IDS else places
        rows = rows.join(places, "patch_id").drop("patch_id").withColumnRenamed("place", "patch_id")
    path = os.path.join(shared_folder(spark).removeprefix("file://"), f"patches-{uuid.uuid4().hex}.bin")
    patchfile.write_occurrences(rows, path)
    found = patchfile.read_patches(spark, path, located=True)
    if places is not None:
        found = found.withColumnRenamed("patch_id", "place").join(places, "place")
    return found.select("patch_id", "hash", "x", "y")


def cover_in_input_order(spark, sf_dir):
    """A cover whose ties fall to the input position: here suppliers come in descending order."""
    nested = ingest.nest_occurrences(occurrences(spark, sf_dir)).withColumn("back", -F.col("patch_id"))
    return cover.PatchSelector().select(ingest.with_slots(nested, ["back"])).select("step", "patch_id", "gain", "covered")


def synthetic_summary(spark, sf_dir):
    """The published small workload: its universe and its cover."""
    rows = synthetic.generate(spark, synthetic.Parameters(10_000, 1_000, 50, 0.4, 42))
    selection = cover.summary(cover.cover_lazy(ingest.incidence(rows)))
    return ingest.universe_size(ingest.incidence(rows)).crossJoin(selection)


def _cover(name: str, partition_by: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cover.cover_lazy(incidences(spark, sf_dir, name), partition_by).select("step", "patch_id", "gain", "covered")

    return query


def _cover_sql(inc: str) -> str:
    return f"""
WITH RECURSIVE inc AS MATERIALIZED ({inc}),
r(step, pid, e, w, g) AS (
  SELECT 1::BIGINT, pid, e, arg_max(pid, struct_pack(n := n, p := -pid)) OVER (), max(n) OVER ()
  FROM (SELECT pid, e, count(*) OVER (PARTITION BY pid) n FROM inc)
  UNION ALL
  SELECT step, pid, e, arg_max(pid, struct_pack(n := n, p := -pid)) OVER (), max(n) OVER ()
  FROM (SELECT step + 1 AS step, pid, e, count(*) OVER (PARTITION BY pid) n FROM r
        WHERE e NOT IN (SELECT e FROM r WHERE pid = w)))
SELECT step, patch_id, gain, CAST(sum(gain) OVER (ORDER BY step) AS BIGINT) AS covered
FROM (SELECT DISTINCT step, w AS patch_id, g AS gain FROM r)"""


def _grouped_cover_sql(inc: str) -> str:
    """As _cover_sql, of all groups y at once; each has its own winner in a step."""
    return f"""
WITH RECURSIVE inc AS MATERIALIZED ({inc}),
r(step, y, pid, e, w, g) AS (
  SELECT 1::BIGINT, y, pid, e, arg_max(pid, struct_pack(n := n, p := -pid)) OVER (PARTITION BY y), max(n) OVER (PARTITION BY y)
  FROM (SELECT y, pid, e, count(*) OVER (PARTITION BY y, pid) n FROM inc)
  UNION ALL
  SELECT step, y, pid, e, arg_max(pid, struct_pack(n := n, p := -pid)) OVER (PARTITION BY y), max(n) OVER (PARTITION BY y)
  FROM (SELECT step + 1 AS step, y, pid, e, count(*) OVER (PARTITION BY y, pid) n FROM r
        WHERE (y, e) NOT IN (SELECT (y, e) FROM r WHERE pid = w)))
SELECT year, step, patch_id, gain, CAST(sum(gain) OVER (PARTITION BY year ORDER BY step) AS BIGINT) AS covered
FROM (SELECT DISTINCT step, y AS year, w AS patch_id, g AS gain FROM r)"""


def _instance_sql(name: str) -> str:
    if name == "customers_parts":
        return "SELECT DISTINCT o_custkey AS pid, l_partkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    if name == "documents_words":  # the selection does not hang on how words are hashed
        return "SELECT DISTINCT doc_id AS pid, unnest(string_split(text, ' ')) AS e FROM documents"
    i = INSTANCES[name]
    return f"SELECT DISTINCT {i.patch} AS pid, {i.sql_element or i.element} AS e FROM {i.table}"


COVERS = ("suppliers_parts", "parts_suppliers", "orders_parts", "customers_parts", "users_hours")


def queries() -> dict[str, Query]:
    plain: dict[str, Query] = {
        "incidence": incidences,
        "patch_size": lambda s, d: ingest.patch_size(incidences(s, d)),
        "universe_size": lambda s, d: ingest.universe_size(incidences(s, d)),
        "hash_degree": lambda s, d: stats.hash_degree(incidences(s, d)),
        "hash_min_location": lambda s, d: stats.min_location(occurrences(s, d)).select("hash", "rep.x", "rep.y"),
    }
    named = (dictionary_encode, reverse_map, patch_csr, inverted_index, patches_of, patch_lookup, sub_csr, longest_rows, sorted_rows, dictionary_unsigned, hash_stats_topk_unsigned, bitset_members_ascending, bitset_and_count, cover_in_input_order, hash_stats_topk, hash_stats_all, stats_records, newly_covered, covered_union, intersect_count, gain_after_k, best_patch, contiguous_slice, element_shard, bitset_popcount, bitset_members, bitset_test, cover_summary, cover_grouped, patch_file_round_trip, synthetic_summary)
    plain |= {f.__name__: f for f in named}
    plain |= {f"greedy_cover_{c}": _cover(c, "patch") for c in (*COVERS, "documents_words")}
    return plain | {f"greedy_cover_{c}_by_element": _cover(c, "element") for c in COVERS}


def oracle_sql() -> dict[str, str]:
    first = FIRST.format(inc=INC)
    done = f"SELECT hash FROM ({INC}) WHERE patch_id IN ({first})"
    gains = f"SELECT patch_id, count(*) AS gain FROM ({INC}) WHERE hash NOT IN ({done}) GROUP BY 1"
    inverted = f"SELECT element_id, string_agg(patch_id::VARCHAR, ',' ORDER BY patch_id) AS patches, count(*) AS n FROM ({ENC}) GROUP BY 1"
    width = f"(((SELECT count(*) FROM ({DICT})) + {SHARDS - 1}) // {SHARDS})"
    local = f"SELECT patch_id, element_id // {width} AS shard, element_id % {width} AS local_id FROM ({ENC})"
    high = f"SELECT DISTINCT {HIGH} AS u FROM ({INC})"
    cells = f"SELECT max(element_id) AS last FROM ({DICT})"
    out = {
        "incidence": INC,
        "patch_size": f"SELECT patch_id, count(*) AS size FROM ({INC}) GROUP BY 1",
        "universe_size": f"SELECT count(DISTINCT hash) AS n FROM ({INC})",
        "hash_degree": f"SELECT hash, count(*) AS degree FROM ({INC}) GROUP BY 1",
        "hash_min_location": f"SELECT hash, rep.x AS x, rep.y AS y FROM ({STATS})",
        "dictionary_encode": DICT,
        "patch_csr": f"SELECT patch_id, string_agg(element_id::VARCHAR, ',' ORDER BY element_id) AS elements FROM ({ENC}) GROUP BY 1",
        "inverted_index": f"SELECT element_id, patches FROM ({inverted})",
        "reverse_map": f"SELECT element_id, hash FROM ({DICT})",
        "patches_of": f"SELECT element_id, patches, n FROM ({inverted}) UNION ALL SELECT last + 1, '', 0 FROM ({cells})",
        "patch_lookup": f"SELECT patch_id, count(*) AS size FROM ({INC}) GROUP BY 1 UNION ALL SELECT max(patch_id) + 1, 0 FROM ({INC})",
        "sub_csr": f"SELECT shard, patch_id, string_agg(local_id::VARCHAR, ',' ORDER BY local_id) AS elements FROM ({local}) GROUP BY 1, 2",
        "longest_rows": f"SELECT shard, max(n) AS longest FROM (SELECT shard, patch_id, count(*) AS n FROM ({local}) GROUP BY 1, 2) GROUP BY 1",
        "sorted_rows": f"SELECT element_id, patch_id FROM ({ENC})",
        "dictionary_unsigned": f"SELECT printf('%016x', u) AS hash, row_number() OVER (ORDER BY u) - 1 AS element_id FROM ({high})",
        "hash_stats_topk_unsigned": f"SELECT printf('%016x', {HIGH}) AS hash, n_patches, rep.x AS x, rep.y AS y FROM ({STATS}) ORDER BY n_patches DESC, {HIGH} LIMIT {TOP}",
        "bitset_members_ascending": f"SELECT patch_id, element_id, row_number() OVER (ORDER BY patch_id, element_id) - 1 AS place FROM ({ENC})",
        "bitset_and_count": f"SELECT count(*) AS n FROM (SELECT element_id FROM ({ENC}) WHERE patch_id = 1 INTERSECT SELECT element_id FROM ({ENC}) WHERE patch_id = 2)",
        "cover_in_input_order": f"SELECT step, -patch_id AS patch_id, gain, covered FROM ({_cover_sql('SELECT DISTINCT -l_suppkey AS pid, l_partkey AS e FROM lineitem')})",
        "hash_stats_all": f"SELECT hash, n_patches, rep.x AS x, rep.y AS y FROM ({STATS})",
        "hash_stats_topk": f"SELECT hash, n_patches, rep.x AS x, rep.y AS y FROM ({STATS}) ORDER BY n_patches DESC, hash LIMIT {TOP}",
        "stats_records": f"SELECT hash, format('{{:016x}}', hash) || chr(9) || format('{{:20d}}', n_patches) || chr(9) || format('{{:25.17e}}', rep.x) || chr(9) || format('{{:25.17e}}', rep.y) AS record FROM ({STATS})",
        "newly_covered": f"SELECT hash FROM ({INC}) WHERE patch_id = 4 EXCEPT ({done})",
        "covered_union": f"SELECT DISTINCT element_id FROM ({ENC}) WHERE patch_id <= 3",
        "intersect_count": f"SELECT count(*) AS n FROM (SELECT hash FROM ({INC}) WHERE patch_id = 1 INTERSECT SELECT hash FROM ({INC}) WHERE patch_id = 2)",
        "gain_after_k": gains,
        "best_patch": f"SELECT patch_id, gain FROM ({gains}) ORDER BY gain DESC, patch_id LIMIT 1",
        "contiguous_slice": f"SELECT patch_id, ((patch_id + 1) * {SHARDS} - 1) // (SELECT count(DISTINCT o_orderkey) FROM orders) AS part FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS patch_id FROM (SELECT DISTINCT o_orderkey FROM orders))",
        "element_shard": f"SELECT element_id, element_id // (((SELECT count(*) FROM ({DICT})) + {SHARDS - 1}) // {SHARDS}) AS shard FROM ({DICT})",
        "bitset_popcount": f"SELECT patch_id, count(*) AS n FROM ({INC}) GROUP BY 1",
        "bitset_members": ENC,
        "bitset_test": f"SELECT element_id, bool_or(patch_id = 1) AS is_set FROM ({ENC}) GROUP BY 1",
        "cover_summary": f"SELECT count(*) AS selected, CAST(sum(gain) AS BIGINT) AS covered, max(step) AS iterations FROM ({_cover_sql(_instance_sql('orders_parts'))})",
        "cover_grouped": _grouped_cover_sql("SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS y, l_suppkey AS pid, l_partkey AS e FROM lineitem"),
        "greedy_cover_documents_words": _cover_sql(_instance_sql("documents_words")),
        "patch_file_round_trip": "SELECT l_suppkey AS patch_id, l_partkey AS hash, l_extendedprice AS x, l_quantity AS y FROM lineitem",
        "synthetic_summary": "SELECT 6019::BIGINT AS n, 353::BIGINT AS selected, 6019::BIGINT AS covered, 353::BIGINT AS iterations",
    }
    for c in COVERS:
        out[f"greedy_cover_{c}"] = out[f"greedy_cover_{c}_by_element"] = _cover_sql(_instance_sql(c))
    return out
