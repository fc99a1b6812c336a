"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a target share of the output's characters. A document of source s is repeated K times, K drawn from a
Poisson distribution with mean rate(s) = share(s) x output characters / characters of s, by inverting its distribution
function at a number hashed from (seed, doc_id, text): no state, so a lost task draws the same again. Copies are then
put into a global random order by a second hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production targets: relative shares of the output; a source that is not listed has DEFAULT_WEIGHT, null included.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
#: Output characters per input character.
EPOCHS = 1.0
SEED = 42
#: exp(-mean) must not underflow: a larger mean is a sum of draws with an equal part of the mean each.
PART = 256.0
#: Sources up to this number travel as a broadcast table of some 200 bytes each; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Parts into which each source is dealt for that shuffled join, so that one hot source is no hot task.
SALTS = 64


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1), a multiple of 2^-53, from the first 52 bits of md5 of the key's parts joined by ``|``."""
    digits = F.substring(F.md5(F.concat_ws("|", *key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float], default: float, epochs: float) -> DataFrame:
    """(source, rate): one row per source that has characters; counted over all documents."""
    size = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.length(F.col("text").cast("string")).cast("long")).alias("size"))
    listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(listed[F.col("source")], F.lit(float(default))) if weights else F.lit(float(default))
    size = size.where("size > 0").withColumn("weight", weight.cast("double"))
    total = size.agg(F.sum("size"), F.sum("weight")).first()
    if not total[0] or not total[1]:
        return size.select("source", F.lit(0.0).alias("rate"))
    out = F.lit(float(total[0])) * F.lit(float(epochs))
    return size.select("source", (F.col("weight") * out / (F.lit(float(total[1])) * F.col("size"))).alias("rate"))


def distribution(rate: DataFrame) -> DataFrame:
    """Adds parts (draws to sum) and cdf: P(K <= 0), P(K <= 1), ... of one draw, until it is 1 in doubles."""
    mean = "(rate / parts)"
    steps = f"sequence(1, cast(ceil({mean} + 12 * sqrt({mean}) + 30) as int))"
    start = f"named_struct('p', exp(-{mean}), 'c', array(exp(-{mean})))"
    step = f"(a, k) -> named_struct('p', a.p * {mean} / k, 'c', array_append(a.c, element_at(a.c, -1) + a.p * {mean} / k))"
    return rate.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("cdf", F.expr(f"aggregate({steps}, {start}, {step}, a -> a.c)"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents' columns with each row repeated by its draw, then copy (int, from 1) and shuffle_key, in its order
    from partition to partition and in each.

    A null or empty text has no characters to mix and a draw like any other of its source; a source without characters
    at all is left out (rate 0). A null source is a source of its own; null ids and texts hash as empty. Repeated rows
    draw alike: equal (doc_id, text) means equal counts. Columns of the input named copy or shuffle_key are replaced;
    others pass through. An empty table gives an empty result.
    """
    taken = [n for n in docs.columns if n not in ("copy", "shuffle_key")]
    small = distribution(rates(docs, weights, default, epochs))
    body = docs.select(*taken).withColumn("__mix_source", F.col("source").cast("string"))
    identity = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("doc_id", "text")]
    body = body.withColumn("__mix_key", F.md5(F.concat_ws("|", F.lit(str(seed)), *identity)))
    rows = small.limit(BROADCAST_SOURCES + 1).collect()
    if len(rows) <= BROADCAST_SOURCES:
        right = F.broadcast(docs.sparkSession.createDataFrame(rows, small.schema))
        rated = body.join(right.withColumnsRenamed({"source": "__mix_right", "rate": "__mix_rate", "parts": "__mix_parts", "cdf": "__mix_cdf"}), F.col("__mix_source").eqNullSafe(F.col("__mix_right")))
    else:
        right = small.withColumnsRenamed({"source": "__mix_right", "rate": "__mix_rate", "parts": "__mix_parts", "cdf": "__mix_cdf"})
        right = right.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        body = body.withColumn("__mix_salt_left", F.pmod(F.xxhash64("__mix_key"), F.lit(SALTS)).cast("int"))
        rated = body.join(right, (F.col("__mix_salt_left") == F.col("__mix_salt")) & F.col("__mix_source").eqNullSafe(F.col("__mix_right")))
    one = F.size(F.filter("__mix_cdf", lambda c: c < F.col("__mix_u")))
    first = rated.withColumn("__mix_u", uniform("__mix_key", F.lit("0"))).withColumn("__mix_n", one)
    rest = F.expr(
        "aggregate(sequence(1, __mix_parts - 1), __mix_n, (n, j) -> n + size(filter(__mix_cdf, c -> c < "
        f"(cast(conv(substring(md5(concat_ws('|', __mix_key, cast(j as string))), 1, 13), 16, 10) as double) + 0.5D) / {float(1 << 52)!r}D)))"
    )
    drawn = first.withColumn("__mix_n", F.when(F.col("__mix_parts") > 1, rest).otherwise(F.col("__mix_n"))).where("__mix_n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", "__mix_key", F.lit("copy"), F.col("copy").cast("string"))))
    # keys are spread evenly, so their leading 32 bits deal the rows out in order: no sampling pass that draws everything twice
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = (F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(partitions) / F.lit(1 << 32)).cast("int")
    dealt = keyed.select(*taken, "copy", "shuffle_key").repartitionById(partitions, place)
    return dealt.sortWithinPartitions("shuffle_key")


#: The query's rows in DuckDB's SQL, with the parameters above.
SQL = f"""
WITH RECURSIVE size AS (
  SELECT source, sum(length(text)) AS size,
         CASE source {' '.join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT!r}::DOUBLE END AS weight
  FROM documents GROUP BY source HAVING sum(length(text)) > 0),
rate AS (
  SELECT source, weight * ((SELECT sum(size) FROM size)::DOUBLE * {EPOCHS!r}::DOUBLE) / ((SELECT sum(weight) FROM size) * size) AS rate FROM size),
part AS (SELECT source, greatest(1, ceil(rate / {PART!r}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {PART!r})) AS mean FROM rate),
cdf AS (
  SELECT source, mean, 0::BIGINT AS k, exp(-mean) AS p, exp(-mean) AS c FROM part
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
doc AS (
  SELECT d.*, part.parts, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key
  FROM documents d JOIN part ON d.source IS NOT DISTINCT FROM part.source),
draw AS (
  SELECT *, (('0x' || substr(md5(key || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM (SELECT *, unnest(range(parts)) AS j FROM doc)),
counted AS (
  SELECT doc_id, draw.source, key, j, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draw.source AND cdf.c < draw.u) AS n FROM draw),
total AS (SELECT doc_id, source, key, sum(n)::BIGINT AS n FROM counted GROUP BY ALL),
copied AS (SELECT doc_id, source, key, unnest(range(1, n + 1))::INTEGER AS copy FROM total)
SELECT c.doc_id, d.text, d.lang, c.source, d.n_chars, c.copy, md5(c.key || '|copy|' || c.copy) AS shuffle_key
FROM copied c JOIN documents d ON c.doc_id = d.doc_id ORDER BY shuffle_key
"""
