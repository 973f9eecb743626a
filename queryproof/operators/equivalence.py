"""Result equivalence at any size: counts, bag fingerprints, samples, differences, ordered compare.

A bag fingerprint is (row count, sum of row hashes, xor of row hashes): order does not matter,
duplicates do, and each task sends one small partial row to the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryproof.functions.canon import NESTED, STRINGS, quoted, row_digest, row_hash
from queryproof.operators.ranking import ranked_rows


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


_NUMBERS = (*_WHOLE, T.DecimalType)
_REAL = (T.FloatType, T.DoubleType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that holds the values of both types, None where they can't be compared.

    Nested types are compared part by part, structs by position with the names of ``a``. A whole number or
    decimal and a double have no type that holds both; they meet as text (see ``common_sql``). Instants
    and wall-clock times are not compared: which is equal to which depends on a time zone.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, STRINGS) and isinstance(b, STRINGS):
        return T.StringType()
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _DIGITS[type(t)])
    if isinstance(a, _REAL) and isinstance(b, _REAL):
        return T.DoubleType()
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        wide = [t if isinstance(t, T.DecimalType) else T.DecimalType(_DIGITS[type(t)], 0) for t in (a, b)]
        scale = max(t.scale for t in wide)
        digits = max(t.precision - t.scale for t in wide) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else None
    if isinstance(a, _NUMBERS + _REAL) and isinstance(b, _NUMBERS + _REAL):
        return T.StringType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        item = common_type(a.elementType, b.elementType)
        return item and T.ArrayType(item)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        key, value = common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType)
        return T.MapType(key, value) if key and value else None
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and len(a) == len(b):
        types = [common_type(f.dataType, g.dataType) for f, g in zip(a, b)]
        return None if None in types else T.StructType([T.StructField(f.name, t) for f, t in zip(a, types)])
    return None


def common_sql(x: str, own: T.DataType, other: T.DataType, common: T.DataType, depth: int = 0) -> str:
    """A value of type ``own`` in its common form with ``other``: equal forms, equal values.

    A double stands for the whole number it is, or else for the decimal it is printed as. The form of a
    double is its text; a number has the text of its nearest double if that double stands for the number
    exactly, and its own digits with a mark otherwise. So 9007199254740993 differs from every double.
    """
    if own == other or isinstance(other, T.NullType):
        return x
    kinds = (own, other)
    if all(isinstance(t, _NUMBERS + _REAL) for t in kinds) and isinstance(common, T.StringType):
        if isinstance(own, _REAL):
            return f"CAST(CAST({x} AS DOUBLE) + 0D AS STRING)"
        d, digits = f"CAST({x} AS DOUBLE)", own.simpleString() if isinstance(own, T.DecimalType) else "decimal(20,0)"
        whole = f"{d} = floor({d}) AND abs({d}) < 9.2E18D"
        stands_for = f"CASE WHEN {whole} THEN try_cast(try_cast({d} AS BIGINT) AS {digits}) ELSE try_cast({d} AS {digits}) END"
        return f"CASE WHEN CAST({x} AS {digits}) = {stands_for} THEN CAST({d} + 0D AS STRING) ELSE concat('#', CAST({x} AS STRING)) END"
    v = f"v{depth}"
    if own == common and not _has_text_form(own, other):
        return x
    if isinstance(own, T.ArrayType) and isinstance(common.elementType, _NUMBERS) or isinstance(own, T.MapType) and _widened(own, common):
        return f"CAST({x} AS {common.simpleString()})"
    if isinstance(own, T.ArrayType) and isinstance(other, T.ArrayType):
        return f"transform({x}, {v} -> {common_sql(v, own.elementType, other.elementType, common.elementType, depth + 1)})"
    if isinstance(own, T.MapType) and isinstance(other, T.MapType):
        key = common_sql(f"{v}.key", own.keyType, other.keyType, common.keyType, depth + 1)
        value = common_sql(f"{v}.value", own.valueType, other.valueType, common.valueType, depth + 1)
        return f"map_from_entries(transform(map_entries({x}), {v} -> struct({key}, {value})))"
    if isinstance(own, T.StructType) and isinstance(other, T.StructType):
        parts = []
        for f, g, c in zip(own, other, common):
            name = c.name.replace("\\", "\\\\").replace("'", "\\'")
            parts.append(f"'{name}', {common_sql(f'{x}.{quoted(f.name)}', f.dataType, g.dataType, c.dataType, depth + 1)}")
        return f"CASE WHEN {x} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    return f"CAST({x} AS {common.simpleString()})"


def _has_text_form(own: T.DataType, other: T.DataType) -> bool:
    """Whether a number meets a double somewhere in the types, so that both become text."""
    if isinstance(own, T.ArrayType) and isinstance(other, T.ArrayType):
        return _has_text_form(own.elementType, other.elementType)
    if isinstance(own, T.MapType) and isinstance(other, T.MapType):
        return _has_text_form(own.keyType, other.keyType) or _has_text_form(own.valueType, other.valueType)
    if isinstance(own, T.StructType) and isinstance(other, T.StructType):
        return any(_has_text_form(f.dataType, g.dataType) for f, g in zip(own, other))
    return isinstance(common_type(own, other), T.StringType) and not isinstance(own, STRINGS + (T.NullType,))


def _widened(own: T.MapType, common: T.MapType) -> bool:
    """Whether a map differs from its common form in numbers alone, for which a plain cast does."""
    pairs = ((own.keyType, common.keyType), (own.valueType, common.valueType))
    return all(a == b and not isinstance(a, NESTED) or isinstance(a, _WHOLE) and isinstance(b, _WHOLE) for a, b in pairs)


def aligned(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with common column types, position by position, so that equal values hash alike.

    Types that hold no common values are an error, found before any data is read. A number column beside
    a column of doubles becomes text on both sides.
    """
    if len(before.columns) != len(after.columns):
        raise ValueError(f"column counts differ: {before.columns} / {after.columns}")
    own, other = ([f.dataType for f in df.schema.fields] for df in (before, after))
    types = [common_type(b, a) for b, a in zip(own, other, strict=True)]
    if None in types:
        raise ValueError(f"column types can't be compared: {'; '.join(schema_differences(before, after))}")

    def cast(df: DataFrame, mine: list[T.DataType], theirs: list[T.DataType]) -> DataFrame:
        if all(m == c for m, c in zip(mine, types, strict=True)):
            return df
        columns = zip(df.columns, mine, theirs, types, strict=True)
        return df.select(*(F.expr(common_sql(quoted(n), m, t, c)).alias(n) for n, m, t, c in columns))

    return cast(before, own, other), cast(after, other, own)


# Row hashes are summed in three slices of at most 24 bits, so that plain BIGINT sums hold
# trillions of rows; the slices are put together once per result row.
_SLICES = ((40, None), (20, 0xFFFFF), (0, 0xFFFFF))


def _bag_aggregates(h: str, suffix: str) -> list[Column]:
    out = [f"count({h}) AS n_{suffix}", f"coalesce(bit_xor({h}), 0L) AS x_{suffix}"]
    for shift, mask in _SLICES:
        part = f"shiftright({h}, {shift})" if shift else h
        if mask is not None:
            part = f"({part} & {mask}L)"
        out.append(f"coalesce(sum({part}), 0L) AS s{shift}_{suffix}")
    return [F.expr(e) for e in out]


def _fingerprint(suffix: str) -> Column:
    """``count:sum:xor`` of a side as text."""
    slices = [
        f"CAST(s{shift}_{suffix} AS DECIMAL(20, 0)) * CAST({2**shift} AS DECIMAL(13, 0))" for shift, _ in _SLICES
    ]
    return F.expr(f"concat_ws(':', n_{suffix}, {' + '.join(slices)}, x_{suffix})")


def bag_fingerprint(df: DataFrame, keys: Sequence[str] = (), algorithm: str = "native") -> DataFrame:
    """``(keys..., n_rows, fingerprint)``; one row for the whole table when there are no keys."""
    hashed = df.select(*keys, row_hash(df, algorithm=algorithm).alias("h"))
    agg = hashed.groupBy(*keys).agg(*_bag_aggregates("h", "rows"))
    return agg.select(*keys, "n_rows", _fingerprint("rows").alias("fingerprint"))


def tagged_hashes(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = (), algorithm: str = "native"
) -> DataFrame:
    """Union of both sides reduced to ``(keys..., h_before, h_after)`` with one side NULL."""
    before, after = aligned(before, after)
    missing = F.lit(None).cast("bigint")
    left = before.select(
        *keys, row_hash(before, algorithm=algorithm).alias("h_before"), missing.alias("h_after")
    )
    right = after.select(
        *keys, missing.alias("h_before"), row_hash(after, algorithm=algorithm).alias("h_after")
    )
    return left.unionByName(right)


def compare_bags(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = (), algorithm: str = "native"
) -> DataFrame:
    """One row per key (or one in all): counts, fingerprints and their status.

    Both sides go through one aggregation. A side that is missing for a key counts zero rows.
    ``vacuous`` marks comparisons where both sides are empty and the match says nothing.
    """
    return _judged(tagged_hashes(before, after, keys, algorithm), keys)


def _judged(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    agg = tagged.groupBy(*keys).agg(
        *_bag_aggregates("h_before", "before"), *_bag_aggregates("h_after", "after")
    )
    same_count = F.col("n_before") == F.col("n_after")
    printed = agg.select(
        *keys, "n_before", "n_after", _fingerprint("before").alias("fp_before"), _fingerprint("after").alias("fp_after")
    )
    return printed.select(
        "*",
        F.when(same_count, "MATCH").otherwise("MISMATCH").alias("count_status"),
        F.when(~same_count, "SKIPPED")
        .when(F.col("fp_before") == F.col("fp_after"), "MATCH")
        .otherwise("MISMATCH")
        .alias("fingerprint_status"),
        ((F.col("n_before") == 0) & (F.col("n_after") == 0)).alias("vacuous"),
    )


def pair_report(pair_id: str, before: DataFrame, after: DataFrame, algorithm: str = "native") -> DataFrame:
    """The one-row proof of a rewrite pair.

    The default hash is Spark's own; ``md5`` gives fingerprints that any SQL engine can recompute.
    """
    return _report(compare_bags(before, after, algorithm=algorithm).select(F.lit(pair_id).alias("pair_id"), "*"))


def _report(compared: DataFrame, *more: str) -> DataFrame:
    return compared.select(
        *more,
        "pair_id",
        "n_before",
        "n_after",
        "fp_before",
        "fp_after",
        F.when(F.col("fp_before") == F.col("fp_after"), "MATCH").otherwise("MISMATCH").alias("status"),
        "vacuous",
    )


def pair_reports(pairs: Sequence[tuple[str, DataFrame, DataFrame]], algorithms: Sequence[str]) -> DataFrame:
    """Reports of many pairs under several hashes, one row for each ``(algorithm, pair_id)``.

    A side is read once, whatever the number of pairs that hold it against columns of the same types, and its
    row texts serve all hashes. One row a side is left for each hash; these rows alone meet by pair.
    """
    sides: dict[tuple, tuple[DataFrame, list[str]]] = {}
    for pair_id, before, after in pairs:
        both = aligned(before, after)
        for role, df, other, form in (("before", before, after, both[0]), ("after", after, before, both[1])):
            key = (id(df), str([f.dataType for f in other.schema.fields]))
            name = pair_id.replace("\\", "\\\\").replace("'", "\\'")
            sides.setdefault(key, (form, []))[1].append(f"struct('{name}' AS pair_id, '{role}' AS role)")

    def fingerprints(df: DataFrame, places: list[str]) -> DataFrame:
        hashed = df.select(*(row_hash(df, algorithm=how).alias(f"h_{how}") for how in algorithms))
        one = hashed.agg(*(a for how in algorithms for a in _bag_aggregates(f"h_{how}", how)))
        each = [F.struct(F.lit(how).alias("algorithm"), F.col(f"n_{how}").alias("n"), _fingerprint(how).alias("fp")) for how in algorithms]
        return one.select(F.inline(F.array(*each))).select("*", F.expr(f"inline(array({', '.join(places)}))"))

    every = reduce(DataFrame.unionByName, [fingerprints(*side) for side in sides.values()])
    of = {(what, role): F.max(F.when(F.col("role") == role, F.col(what))).alias(f"{what}_{role}") for what in ("n", "fp") for role in ("before", "after")}
    met = every.groupBy("algorithm", "pair_id").agg(*of.values())
    vacuous = ((F.col("n_before") == 0) & (F.col("n_after") == 0)).alias("vacuous")
    return _report(met.select("*", vacuous), "algorithm")


def compare_batch(pairs: Sequence[tuple[str, DataFrame, DataFrame]], algorithm: str = "native") -> DataFrame:
    """Reports for many pairs, one row each.

    All hashes meet in one aggregation by pair: one shuffle of partial rows for the whole batch. A
    row without hashes stands for each pair, so that pairs which are empty on both sides show up.
    """

    def tagged(pair_id: str, before: DataFrame, after: DataFrame) -> DataFrame:
        none = F.lit(None).cast("bigint")
        marker = before.sparkSession.range(1).select(none.alias("h_before"), none.alias("h_after"))
        hashes = tagged_hashes(before, after, algorithm=algorithm).unionByName(marker)
        return hashes.select(F.lit(pair_id).alias("pair_id"), "h_before", "h_after")

    return _report(_judged(reduce(DataFrame.unionByName, [tagged(*p) for p in pairs]), ["pair_id"]))


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of both sides and their status, without hashing anything."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    agg = sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_after"),
    )
    return agg.withColumn(
        "status", F.when(F.col("n_before") == F.col("n_after"), "MATCH").otherwise("MISMATCH")
    )


def key_sample(
    df: DataFrame, keys: Sequence[str], modulus: int, keep: int, algorithm: str = "native"
) -> DataFrame:
    """Rows whose key hash falls into ``keep`` of ``modulus`` classes: the same keys on every side."""
    return df.filter(F.pmod(row_hash(df, list(keys), algorithm), F.lit(modulus)) < keep)


def compare_sample(
    before: DataFrame, after: DataFrame, keys: Sequence[str], modulus: int, keep: int, algorithm: str = "native"
) -> DataFrame:
    """Bag comparison of the same deterministic key sample on both sides."""
    before, after = aligned(before, after)
    sides = [key_sample(df, keys, modulus, keep, algorithm) for df in (before, after)]
    return compare_bags(*sides, algorithm=algorithm)


def diff_rows(before: DataFrame, after: DataFrame, path: str | None = None) -> DataFrame:
    """Rows whose multiplicity differs, with ``n_before`` and ``n_after``.

    Without a path this is one aggregation over all columns, which shuffles every row. With a
    ``path`` in shared storage, 128-bit digests are counted first and the uneven ones are written
    there; rows are then looked up by digest before they are grouped. The written table has a known
    size, so Spark broadcasts it when it is below its threshold (no full row is shuffled but the
    differing ones) and shuffles when it is not. Both inputs are then read twice.
    """
    before, after = aligned(before, after)
    names = before.columns

    def side(df: DataFrame, in_before: int) -> DataFrame:
        digest = row_digest(df)
        return df.select(*names, digest["a"].alias("_d1"), digest["b"].alias("_d2"), F.lit(in_before).alias("_b"))

    rows = side(before, 1).unionByName(side(after, 0))
    n_before, n_after = F.sum("_b"), F.sum(1 - F.col("_b"))
    if path is not None:
        uneven = rows.groupBy("_d1", "_d2").agg(n_before.alias("_nb"), n_after.alias("_na")).filter("_nb <> _na")
        uneven.select("_d1", "_d2").write.mode("overwrite").parquet(path)
        rows = rows.join(before.sparkSession.read.parquet(path), ["_d1", "_d2"], "left_semi")
    counted = rows.groupBy(*names).agg(n_before.alias("n_before"), n_after.alias("n_after"))
    return counted.filter(F.col("n_before") != F.col("n_after"))


def changed_cells(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key..., change, column_name, old_value, new_value)`` for every cell that differs.

    Rows are matched by key, NULL keys with each other. A row that one side lacks gives one row with
    the change INSERTED or DELETED and no column; a key that a side holds more than once gives one row
    with the change DUPLICATE_KEY instead of cells that could not be told apart.
    """
    before, after = aligned(before, after)
    others = [c for c in before.columns if c not in key]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        values = F.struct(*(F.col(c).cast("string").alias(c) for c in others)) if others else F.struct(F.lit(1).alias("_"))
        keyed = df.select(F.struct(*key).alias("_key"), values.alias("_row"))
        return keyed.groupBy("_key").agg(F.count("*").alias(f"_n_{prefix}"), F.first("_row").alias(f"_{prefix}"))

    joined = side(before, "old").join(side(after, "new"), "_key", "full")

    def cell(change: str, condition: Column, name: str | None = None) -> Column:
        column, old, new = (F.lit(name), F.col(f"_old.`{name}`"), F.col(f"_new.`{name}`")) if name else [F.lit(None)] * 3
        fields = (column, "column_name"), (old, "old_value"), (new, "new_value")
        return F.when(condition, F.struct(F.lit(change).alias("change"), *(c.cast("string").alias(n) for c, n in fields)))

    double = (F.coalesce("_n_old", F.lit(0)) > 1) | (F.coalesce("_n_new", F.lit(0)) > 1)
    both = F.col("_n_old").isNotNull() & F.col("_n_new").isNotNull() & ~double
    cells = [
        cell("DUPLICATE_KEY", double),
        cell("INSERTED", F.col("_n_old").isNull() & ~double),
        cell("DELETED", F.col("_n_new").isNull() & ~double),
        *(cell("CHANGED", both & ~F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`")), c) for c in others),
    ]
    return joined.select(*(F.col(f"_key.{k}").alias(k) for k in key), F.inline(F.array_compact(F.array(*cells))))


def compare_ordered_bags(
    before: DataFrame,
    before_order: Sequence[tuple[str, str]],
    after: DataFrame,
    after_order: Sequence[tuple[str, str]],
    algorithm: str = "native",
) -> DataFrame:
    """Ordered equality from fingerprints alone: each row is hashed with its position.

    Cheaper than ``compare_ordered``, which also counts the differing positions.
    """
    before, after = aligned(before, after)
    left = ranked_rows(before, [], before_order, "pos")
    right = ranked_rows(after, [], after_order, "pos")
    return compare_bags(left, right, algorithm=algorithm)


def compare_ordered(
    before: DataFrame,
    before_order: Sequence[tuple[str, str]],
    after: DataFrame,
    after_order: Sequence[tuple[str, str]],
) -> DataFrame:
    """Position-by-position comparison of two ordered results, one row.

    Rows are numbered in ranges of the order, each shifted by the counts of earlier ranges, so no task
    ever holds the whole result.
    """
    before, after = aligned(before, after)
    left = ranked_rows(before, [], before_order, "pos")
    right = ranked_rows(after, [], after_order, "pos")
    lh = left.select("pos", row_hash(before).alias("h_before"))
    rh = right.select("pos", row_hash(after).alias("h_after"))
    joined = lh.join(rh, "pos", "full")
    same = F.col("h_before").eqNullSafe(F.col("h_after"))
    return joined.agg(
        F.count("h_before").alias("n_before"),
        F.count("h_after").alias("n_after"),
        F.count_if(~same).alias("n_positions_different"),
        F.when(F.count_if(~same) == 0, "MATCH").otherwise("MISMATCH").alias("ordered_status"),
    )


def evidence_ledger(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two evidence rows per compared key: the row count and the full fingerprint."""
    matched = F.col("fingerprint_status") == "MATCH"
    count_row = F.struct(
        F.lit("DB_COUNT").alias("source"),
        F.lit("row_count").alias("fingerprint_key"),
        F.col("n_after").cast("string").alias("observed"),
        F.col("n_before").cast("string").alias("expected"),
        F.when(F.col("count_status") == "MATCH", "EXACT").otherwise("NONE").alias("match_strength"),
        F.lit("DB_COUNT").alias("evidence_level"),
        F.lit("row count comparison").alias("notes"),
    )
    skipped = F.col("fingerprint_status") == "SKIPPED"
    hash_row = F.struct(
        F.lit("DB_FINGERPRINT").alias("source"),
        F.lit("key_set_hash").alias("fingerprint_key"),
        F.when(~skipped, F.col("fp_after")).alias("observed"),
        F.when(~skipped, F.col("fp_before")).alias("expected"),
        F.when(matched, "EXACT").otherwise("NONE").alias("match_strength"),
        F.lit("DB_FINGERPRINT").alias("evidence_level"),
        F.when(skipped, "skipped: row counts differ")
        .otherwise("full row-set fingerprint")
        .alias("notes"),
    )
    return compared.select(*keys, F.inline(F.array(count_row, hash_row)))


def schema_differences(before: DataFrame, after: DataFrame) -> list[str]:
    """Plan-time check: positions where column names or types differ (no data is read)."""
    out = []
    for i, (b, a) in enumerate(zip(before.schema.fields, after.schema.fields)):
        if b.name != a.name or b.dataType != a.dataType:
            out.append(f"{i}: {b.name} {b.dataType.simpleString()} / {a.name} {a.dataType.simpleString()}")
    if len(before.columns) != len(after.columns):
        out.append(f"column counts: {len(before.columns)} / {len(after.columns)}")
    return out


