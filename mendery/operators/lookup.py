"""Joins of many rows to facts about their keys, built so that a hot key cannot fill one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.session import settle_table

# A key carried by at least this many rows is hot. At most rows / HOT_KEY_ROWS keys can be hot, which
# bounds what is broadcast below: 10**12 rows give no more than 500 000 keys.
HOT_KEY_ROWS = 2_000_000
_SALTS = 1_000_003


def estimated_bytes(frame: DataFrame) -> int | None:
    """Catalyst's upper size estimate of a frame, or None where the session does not expose it."""
    try:
        return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def below_broadcast_limit(frame: DataFrame) -> bool:
    """True when Spark itself would broadcast the frame by its size threshold."""
    size = estimated_bytes(frame)
    limit = frame.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    text = str(limit).strip().lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    number = int(text.rstrip("kmg") or 0) * scale
    return size is not None and 0 <= size <= number


def keyed_lookup(
    rows: DataFrame,
    facts: DataFrame,
    keys: dict[str, Column],
    values: list[str],
    row_salt: Column,
    weight: str = "n_rows",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Left join of ``rows`` to ``facts`` (one row per key) that stays even under any key skew.

    ``keys`` maps the key columns of ``facts`` to expressions over ``rows``; ``facts`` also holds
    ``weight``, the number of rows that carry the key, which the pre-aggregation that made the facts
    knows anyway.

    The facts are written to the shared folder first, so the join is planned with their real size. Facts
    are about exceptions and mostly few: then Spark broadcasts them by its own threshold and the wide
    rows are not shuffled at all. Otherwise the facts of hot keys are broadcast, whose number is bounded
    by ``hot_rows``, and all other facts are joined on (key, salt): the salt is 0 for rows that still
    need a match and spread for rows that do not (hot or NULL key), so neither kind fills a partition.
    """
    facts = settle_table(facts, "facts")
    names = list(keys)
    key_columns = {n: f"__key_{i}" for i, n in enumerate(names)}
    out = rows.withColumns({key_columns[n]: keys[n] for n in names})

    def side(part: DataFrame, label: str) -> DataFrame:
        renamed = [F.col(n).alias(f"__{label}_{i}") for i, n in enumerate(names)]
        return part.select(*renamed, F.struct(*values).alias(f"__{label}_facts"))

    def match(label: str) -> list[Column]:
        return [F.col(key_columns[n]) == F.col(f"__{label}_{i}") for i, n in enumerate(names)]

    if below_broadcast_limit(facts):
        out = out.join(side(facts, "few"), _all(match("few")), "left")
        found = F.col("__few_facts")
        return out.select(*rows.columns, *[found[v].alias(v) for v in values])

    hot = side(facts.filter(F.col(weight) >= hot_rows), "hot")
    cold = side(facts.filter(F.col(weight) < hot_rows), "cold").withColumn(
        "__cold_salt", F.lit(0).cast("bigint")
    )
    out = out.join(F.broadcast(hot), _all(match("hot")), "left")
    settled = F.col("__hot_facts").isNotNull() | F.col(key_columns[names[0]]).isNull()
    out = out.withColumn(
        "__salt",
        F.when(settled, F.pmod(F.xxhash64(row_salt), F.lit(_SALTS)) + 1).otherwise(F.lit(0).cast("bigint")),
    )
    out = out.join(cold, _all([*match("cold"), F.col("__salt") == F.col("__cold_salt")]), "left")
    found = F.coalesce(F.col("__hot_facts"), F.col("__cold_facts"))
    return out.select(*rows.columns, *[found[v].alias(v) for v in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def held_by(reference: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct keys of ``reference`` (``__known``) that are among ``probes`` (``__probe``)."""
    wanted = probes.select("__probe")
    return reference.join(wanted, F.col("__known") == F.col("__probe"), "left_semi").distinct()


def known_flag(
    rows: DataFrame,
    key: Column,
    known: DataFrame,
    flag: str,
    row_salt: Column,
) -> DataFrame:
    """Add ``flag``: whether ``key`` occurs in ``known`` (one column of keys).

    A reference below Spark's broadcast threshold is joined directly. A larger one is first reduced
    to what matters: the distinct keys of ``rows`` (pre-aggregated before the shuffle) that the
    reference does *not* hold. That set is usually tiny, and joining it back moves few or no wide rows.

    The reference is reduced by those keys before anything else happens to it. They are written, so
    their size is known: where Spark broadcasts them the reference is only scanned, and where they are
    too many it filters the scan with a Bloom filter of them. It is never made distinct as a whole.
    """
    (column,) = known.columns
    reference = known.select(F.col(column).alias("__known")).filter(F.col("__known").isNotNull())
    if below_broadcast_limit(reference):
        marked = reference.distinct().select("__known", F.lit(True).alias("__is_known"))
        out = rows.withColumn("__probe", key).join(marked, F.col("__probe") == F.col("__known"), "left")
        return out.select(*rows.columns, F.coalesce(F.col("__is_known"), F.lit(False)).alias(flag))

    probes = rows.select(key.alias("__probe")).filter(F.col("__probe").isNotNull()).groupBy("__probe").agg(F.count("*").alias("n_rows"))
    probes = settle_table(probes, "probes")
    unknown = probes.join(held_by(reference, probes), F.col("__probe") == F.col("__known"), "left_anti").withColumn("__is_unknown", F.lit(True))
    out = keyed_lookup(rows, unknown, {"__probe": key}, ["__is_unknown"], row_salt)
    is_known = F.col("__is_unknown").isNull() & F.coalesce(key.isNotNull(), F.lit(False))
    return out.select(*rows.columns, is_known.alias(flag))
