"""Mixing of sources to target weights by systematic sampling.

A source's target is its share of all characters, by weight. The documents of a source
have an expected number of copies each, target over size, in units of 2**-24; their prefix
sum in order of hashed id, plus one random offset per source, crosses whole numbers, and each
crossing emits the document once. So every document comes out floor or ceil of its expected
copies, and a source's total is off its target by less than one document's copies.

The prefix sum takes two levels: within buckets of hashed ids, whose sizes don't depend on how ids
are spread, so that a hot source goes to many tasks; and over the buckets' totals. All sums are
of integers, hence the same in any order of execution and after a lost executor.

Defined results: a null source is a source of its own; weights of sources that `weights`
doesn't name are `other`; null or negative sizes count 0, and a source without characters
emits nothing, as does one of weight 0. Ids may be of any type and value; rows without one are
ordered by a hash of all columns, as are rows with the same id, so repeated rows are sampled one
by one. An empty table gives an empty one. All columns are kept, whatever their names; `copy` is
added where asked for, replacing any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Shares of the mixture in thousandths.
WEIGHTS = {"src0": 100, **{f"src{i}": 60 for i in range(1, 10)}, **{f"src{i}": 36 for i in range(10, 20)}}
OTHER = 36
SEED = "mix-1"
ONE = 1 << 24
#: Documents to a bucket of hashed ids, on average.
BUCKET = 1 << 16
#: Sources whose rates are broadcast, at most. Of more, those of many documents are; the rest, none
#: of which holds more than one document in FEW, is joined by a shuffle.
FEW = 100_000
#: Bits of the hash that orders ids.
BITS = 60


def _weight(source: Column, weights: dict[str, int], other: int) -> Column:
    if not weights:
        return F.lit(other)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, source), F.lit(other))


def _offset(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), source).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(ONE)


def _place(identity: Column) -> Column:
    """A number of BITS bits for each id, for the order; SQL has the same."""
    return F.conv(F.substring(F.md5(identity.cast("string").cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def mix(df: DataFrame, weights: dict[str, int] | None = None, other: int = OTHER, seed: str = SEED, id_col: str = "doc_id", source: str = "source", size: str = "n_chars", copy: str | None = None, few: int = FEW) -> DataFrame:
    """The rows of df, each as often as the sampling emits it; with the copy's number in `copy`."""
    weights = WEIGHTS if weights is None else weights
    rest = [f for f in df.schema if copy is None or f.name.lower() != copy.lower()]
    hashable = [F.col(f"`{f.name}`") for f in rest if "map" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{f.name}`") for f in rest])
    # Names of our own beside one struct: columns of the input can't clash with them.
    tie = F.xxhash64(*hashable)
    docs = df.select(row.alias("row"), _place(F.coalesce(F.col(f"`{id_col}`").cast("string"), tie.cast("string"))).alias("at"), F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("src"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"), tie.alias("tie"))
    sizes = docs.groupBy("src").agg(F.sum("size").alias("chars"), F.count("*").alias("n")).withColumn("w", _weight(F.col("src"), weights, other)).where("chars > 0 and w > 0")
    whole = sizes.agg(F.sum("w").alias("all_w"), F.sum("chars").alias("all_chars"), F.sum("n").alias("all_n"))
    share = F.floor(F.col("w").cast("double") * F.col("all_chars").cast("double") * F.lit(float(ONE)) / (F.col("all_w").cast("double") * F.col("chars").cast("double"))).cast("bigint")
    # As many high bits of the hash as give buckets of about BUCKET documents
    bits = F.greatest(F.ceil(F.log2(F.col("all_n") / F.lit(float(BUCKET)))), F.lit(0)).cast("int")
    rates = cut(sizes.crossJoin(F.broadcast(whole)).select("src", share.alias("rate"), _offset(F.col("src"), seed).alias("offset"), "n", "all_n", bits.alias("bits")))  # one row
    bucket = F.expr(f"shiftright(at, {BITS} - bits)")

    def rated(rows: DataFrame) -> DataFrame:
        if rates.count() <= few:
            return rows.join(F.broadcast(rates), "src")
        hot = rates.where(F.col("n") > F.col("all_n") / few)  # `few` rows at most
        return rows.join(F.broadcast(hot), "src").unionByName(rows.join(F.broadcast(hot.select("src")), "src", "left_anti").join(rates, "src"))

    each = rated(docs).select("row", "at", "id", "tie", "src", "rate", "offset", bucket.alias("bucket"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rated(docs.select("src", "at")).select("src", "rate", bucket.alias("bucket")).groupBy("src", "bucket").agg(F.sum("rate").alias("here")).select("src", "bucket", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("at", F.asc_nulls_first("id"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.col("inside") + F.col("offset")
    # A shift is an exact floor division by 2**24
    copies = (F.shiftright(end, 24) - F.shiftright(end - F.col("rate"), 24)).cast("int")
    out = each.withColumn("inside", F.sum("rate").over(inside)).join(before, ["src", "bucket"]).select("row", copies.alias("copies")).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return out.select("row.*", F.col("nth").alias(copy)) if copy else out.select("row.*")


def sql(weights: dict[str, int] | None = None, other: int = OTHER, seed: str = SEED) -> str:
    """The same sample of table documents in SQL: doc_id, source, copy."""
    weights = WEIGHTS if weights is None else weights
    case = "CASE src " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS src, greatest(coalesce(n_chars, 0), 0) AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, {BITS // 4}))::BIGINT AS place FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS chars, {case} AS w FROM d GROUP BY src),
k AS (SELECT * FROM s WHERE chars > 0 AND w > 0),
a AS (SELECT sum(w)::BIGINT AS all_w, sum(chars)::BIGINT AS all_chars FROM k),
r AS (SELECT src, floor(w::DOUBLE * all_chars::DOUBLE * {float(ONE)}::DOUBLE / (all_w::DOUBLE * chars::DOUBLE))::BIGINT AS rate,
  ('0x' || substr(md5('{seed}:' || src), 1, 8))::BIGINT % {ONE} AS o FROM k, a),
p AS (SELECT doc_id, source, rate, sum(rate) OVER (PARTITION BY src ORDER BY place, doc_id::VARCHAR NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT + o AS e
  FROM d JOIN r USING (src)),
c AS (SELECT doc_id, source, ((e >> 24) - ((e - rate) >> 24))::INTEGER AS copies FROM p)
SELECT doc_id, source, unnest(range(1, copies + 1))::INTEGER AS copy FROM c WHERE copies > 0"""
