"""Scalar expressions: missing values, lenient casts, zones, packages, progress and cost components.

Every function returns a Column built from JVM expressions, so all of them stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

UNKNOWN_ZONE = "UNKNOWN_ZONE"

# Texts that mean "no zone", for each of the three reading rules.
ZONE_NULL_TOKENS_ANY_CASE = ("UNKNOWN", "UNKNOWN_ZONE", "NAN", "NONE", "NULL")
ZONE_NULL_TOKENS_ANY_CASE_KEEP_UNKNOWN = ("NAN", "NONE", "NULL")
ZONE_NULL_TOKENS_EXACT = ("nan", "NaN", "None", "null")
SCORE_NULL_TOKENS = ("", "nan", "NaN", "None", "null")
TRUE_TOKENS = ("true", "1", "yes", "y")

# Metrics for which a smaller value is better.
LOWER_IS_BETTER = (
    "generated_total_travel_time",
    "travel_time_ratio_to_actual",
    "zone_change_count",
    "avg_travel_time_ratio_to_actual",
    "avg_zone_change_count",
)


def number_is_missing(c: Column) -> Column:
    """True for null, NaN and both infinities."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))


def text_is_missing(c: Column) -> Column:
    """True for null and for text that is blank after trimming."""
    return c.isNull() | (F.trim(c) == "")


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing test chosen by the column's declared type."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_is_missing(F.col(name))
    if isinstance(kind, T.StringType):
        return text_is_missing(F.col(name))
    return F.col(name).isNull()


def finite(c: Column) -> Column:
    """The number itself, or null when it is NaN or infinite."""
    return F.when(~number_is_missing(c), c)


def sanitize(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null in every column, also inside structs, arrays and maps."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(kind, T.ArrayType) and _holds_floats(kind.elementType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType) and _holds_floats(kind.valueType):
            return F.transform_values(c, lambda _k, v: clean(v, kind.valueType))
        if isinstance(kind, T.StructType) and _holds_floats(kind):
            parts = [clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*parts))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind.fields)
    return False


def sorted_map_json(c: Column) -> Column:
    """JSON text of a map with its keys in ascending order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def flag(c: Column) -> Column:
    """Boolean to 0/1; null counts as 0."""
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def to_bool(c: Column) -> Column:
    """Text, number or boolean to boolean: true, 1, yes and y are true, everything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def to_number(c: Column) -> Column:
    """Number, or null where the text cannot be read as one."""
    return c.try_cast("double")


def to_int(c: Column, default: int = 0) -> Column:
    """Whole number, truncating toward zero; yes/no words become 1/0; anything else the default."""
    text = F.lower(F.trim(c.cast("string")))
    number = finite(text.try_cast("double")).try_cast("long")
    word = F.when(text.isin("true", "yes", "y"), F.lit(1)).when(text.isin("false", "no", "n"), F.lit(0))
    return F.coalesce(number, word.cast("long"), F.lit(default).cast("long"))


def to_float(c: Column, default: float | None = 0.0) -> Column:
    """Number, or the default where the value is missing or unreadable."""
    number = finite(F.trim(c.cast("string")).try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def first_present(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """First non-missing value among the listed columns that the frame has."""
    found = [F.when(~is_missing(df, n), F.col(n)) for n in names if n in df.columns]
    if default is not None:
        found.append(default)
    return F.coalesce(*found) if found else F.lit(None)


def normalize_zone(c: Column, rule: str = "any_case") -> Column:
    """Zone text, or UNKNOWN_ZONE. Rules: any_case, any_case_keep_unknown, exact, blank_only."""
    text = F.trim(c)
    if rule == "any_case":
        empty = F.upper(text).isin(*ZONE_NULL_TOKENS_ANY_CASE)
    elif rule == "any_case_keep_unknown":
        empty = F.upper(text).isin(*ZONE_NULL_TOKENS_ANY_CASE_KEEP_UNKNOWN)
    elif rule == "exact":
        empty = text.isin(*ZONE_NULL_TOKENS_EXACT)
    elif rule == "blank_only":
        empty = F.lit(False)
    else:
        raise ValueError(f"unknown zone rule: {rule}")
    return F.when(text_is_missing(c) | empty, F.lit(UNKNOWN_ZONE)).otherwise(text)


def zone_pair_flags(left: Column, right: Column) -> dict[str, Column]:
    """Mutually exclusive 0/1 flags of two normalised zones."""
    unknown = (left == UNKNOWN_ZONE) | (right == UNKNOWN_ZONE)
    return {
        "same_zone": flag(~unknown & (left == right)),
        "zone_changed": flag(~unknown & (left != right)),
        "zone_missing_in_pair": flag(unknown),
    }


def clean_route_score(c: Column) -> Column:
    """Route score with every spelling of nothing turned into Missing."""
    text = F.trim(c)
    return F.when(c.isNull() | text.isin(*SCORE_NULL_TOKENS), F.lit("Missing")).otherwise(text)


def scan_status_class(c: Column) -> Column:
    """delivered, attempted, rejected or unknown, by the first matching part of the text."""
    text = F.lower(c)
    return (
        F.when(text.contains("delivered"), "delivered")
        .when(text.contains("attempt"), "attempted")
        .when(text.contains("reject"), "rejected")
        .otherwise("unknown")
    )


def has_window(start: Column, end: Column) -> Column:
    """True when both ends of a time window are given."""
    return ~text_is_missing(start) & ~text_is_missing(end)


def package_volume(length: Column, width: Column, height: Column) -> Column:
    """Length x width x height, null when any of them is missing."""
    return finite(length) * finite(width) * finite(height)


def progress_of_stops(position: Column, stops: Column) -> Column:
    """position / (stops - 1) clipped to [0, 1]; 0 when that is undefined."""
    share = F.try_divide(position.cast("double"), (stops - 1).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))


def progress_of_sequence(position: Column, length: Column) -> Column:
    """position / (length - 1), or 0 for a sequence of one stop."""
    return F.when(length <= 1, F.lit(0.0)).otherwise(position.cast("double") / (length - 1).cast("double"))


def progress_of_serving(position: Column, stops: Column) -> Column:
    """position / max(stops - 1, 1)."""
    return position.cast("double") / F.greatest(stops - 1, F.lit(1)).cast("double")


def percent_of(part: Column, total: Column) -> Column:
    """100 * part / total, 0 when the total is 0."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, total.cast("double")), F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 when the total is 0 or absent."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def clip_probability(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def sigmoid(z: Column, bound: float = 700.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))))


def zone_penalty(missing: Column, changed: Column) -> Column:
    return F.when(missing == 1, F.lit(0.5)).otherwise(changed.cast("double"))


def window_risk(has_time_window: Column) -> Column:
    return F.when(has_time_window == 1, F.lit(0.0)).otherwise(F.lit(1.0))


def workload(packages: Column, service: Column, windows: Column, volume: Column) -> Column:
    return packages + service / 60.0 + windows + volume / 10000.0


def weighted_cost(components: Sequence[Column], weights: Sequence[Column | float]) -> Column:
    """Sum of weight x component."""
    terms = [(w if isinstance(w, Column) else F.lit(float(w))) * c for w, c in zip(weights, components)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def parse_weights(text: str, names: Sequence[str]) -> dict[str, float]:
    """Comma-separated weights; negatives count as 0 and the rest is scaled to sum 1."""
    values = [max(float(part), 0.0) for part in text.split(",")]
    if len(values) != len(names):
        raise ValueError(f"expected {len(names)} weights, got {len(values)}")
    total = sum(values)
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    return {n: v / total for n, v in zip(names, values)}


def weights_of_text(c: Column, names: Sequence[str]) -> Column:
    """``parse_weights`` of a text column, as a struct; null where that would be an error."""
    values = F.transform(F.split(c, ","), lambda x: F.greatest(F.expr("0D"), to_number(x)))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    fits = (F.size(values) == len(names)) & F.forall(F.split(c, ","), lambda x: to_number(x).isNotNull()) & (total > 0)
    return F.when(fits, F.struct(*[(values[i] / total).alias(n) for i, n in enumerate(names)]))


def metric_direction(c: Column) -> Column:
    return F.when(c.isin(*LOWER_IS_BETTER), "lower_is_better").otherwise("higher_is_better")


def display_name(c: Column, names: Mapping[str, str]) -> Column:
    """Label of a code; codes without a label pass through."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def round_numbers(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Every floating column rounded."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def hash_key(seed: int, *parts: Column) -> Column:
    """Reproducible pseudo-random text of a key; ordering by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(seed: int, *parts: Column) -> Column:
    """Reproducible whole number in [0, 2^32) of a key."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("long")
