"""Column expressions for severities, categories, verdicts, digests, markup and prompts."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The severity scale, error families and their aliases.
SEVERITIES = ("none", "minor", "major", "critical")
CATEGORIES = ("accuracy", "terminology", "fluency", "style", "locale")
ACCURACY_ALIASES = ("mistranslation", "omission", "addition", "wrong_named_entity")
FLUENCY_ALIASES = ("grammar", "agreement", "punctuation", "word_order", "unnatural_flow")
_BLANKS = " \t\n\r\x0b\x0c"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _stripped(value: Column | str) -> Column:
    return F.btrim(F.coalesce(_c(value), F.lit("")), F.lit(_BLANKS))


def severity_rank(severity: Column | str) -> Column:
    """none, minor, major, critical as 0 to 3; anything else and null: null."""
    s = _c(severity)
    return reduce(lambda out, i: out.when(s == SEVERITIES[i], F.lit(i)), range(1, 4), F.when(s == SEVERITIES[0], F.lit(0)))


def severity_name(rank: Column | str) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), _c(rank).cast("int"))


def normalize_severity_strict(value: Column | str) -> Column:
    """Trimmed, lower-cased, `_` as `-`; empty, no-error and neutral are none; unknown values are null (to be rejected)."""
    v = F.replace(F.lower(_stripped(value)), F.lit("_"), F.lit("-"))
    return F.when(v.isin("", "no-error", "neutral", "none"), F.lit("none")).when(v.isin(*SEVERITIES[1:]), v)


def require_severity(value: Column | str) -> Column:
    """As `normalize_severity_strict`, but an unknown value fails the job and is named."""
    known = normalize_severity_strict(value)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), _c(value))))


def _family(v: Column) -> Column:
    out = F.when(v.isin("", "no-error"), F.lit("none"))
    for name in CATEGORIES:
        out = out.when(v.startswith(name), F.lit(name))
    return out


def _category(value: Column | str) -> Column:
    return F.lower(_stripped(value))


def normalize_category_strict(value: Column | str) -> Column:
    """The error family by prefix; empty and no-error: none; else other."""
    return _family(_category(value)).otherwise("other")


def normalize_category_lenient(value: Column | str) -> Column:
    """As the strict form, with aliases of accuracy and fluency."""
    v = _category(value)
    return _family(v).when(v.isin(*ACCURACY_ALIASES), "accuracy").when(v.isin(*FLUENCY_ALIASES), "fluency").otherwise("other")


def normalize_phenomenon(value: Column | str, default: str = "unspecified") -> Column:
    """Lower case, trimmed, `/` as `.`; null and empty: the default."""
    return F.coalesce(F.nullif(F.replace(F.lower(F.trim(_c(value))), F.lit("/"), F.lit(".")), F.lit("")), F.lit(default))


def max_severity_of_errors(errors: Column | str) -> Column:
    """The highest severity in an error array; none if it is empty or null."""
    return severity_name(F.coalesce(F.array_max(F.transform(_c(errors), lambda e: severity_rank(e["severity"]))), F.lit(0)))


def primary_category_of_errors(errors: Column | str) -> Column:
    """The category of the first error that has the highest severity; none without errors."""
    e = _c(errors)
    ranks = F.transform(e, lambda x: severity_rank(x["severity"]))
    place = F.array_position(ranks, F.array_max(ranks))
    return F.coalesce(F.get(F.transform(e, lambda x: x["category"]), (place - 1).cast("int")), F.lit("none"))


def swap_verdict(verdict: Column | str) -> Column:
    v = _c(verdict)
    return F.when(v == "candidate_a", F.lit("candidate_b")).when(v == "candidate_b", F.lit("candidate_a")).otherwise(v)


def slugify(value: Column | str) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, no dash at the ends; nothing left: unknown."""
    dashed = F.regexp_replace(F.lower(F.coalesce(_c(value), F.lit(""))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _escaped(value: Column) -> Column:
    body = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    cut = _bound(body, lambda t: F.substring(t, F.lit(6), F.length(t) - 6))

    def lowered(text: Column) -> Column:
        out = text
        for upper in ("000B", "000E", "000F", *(f"001{c}" for c in "ABCDEF")):
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{upper}", rf"$1\\u{upper.lower()}")
        return F.when(text.rlike(r"\\u00[01][0-9A-F]*[A-F]"), out).otherwise(text)

    return _bound(cut, lowered)


def quoted(value: Column | str) -> Column:
    """A string as a JSON string; control characters with lower-case hexadecimal digits. Only texts with something to escape go through a JSON writer."""
    v = _c(value)
    plain = F.is_valid_utf8(v) & ~v.rlike(r'["\\\x00-\x1f]')
    return F.when(plain, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(_escaped(v))


def canonical_json(fields: dict[str, Column], compact: bool = False) -> Column:
    """A JSON object of string fields with sorted keys; `compact`: no space after commas and colons. For values of any type see `canonical_text`."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else comma) + f'"{key}"' + colon), quoted(fields[key])]
    return F.concat(*parts, F.lit("}"))


def double_text(value: Column) -> Column:
    """The fewest digits that name a double, as 0.0001, 1e-05, 1234567.5, 1e+16; NaN, Infinity and -Infinity by name. Subnormal numbers may have a digit too many.

    Where Spark's own text has at most 15 digits, these are the fewest, as no two such numbers are one double; others are looked for.
    """
    return _bound(value.cast("double"), lambda v: _bound(v.cast("string"), lambda own: _number(v, own)))


def _number(v: Column, own: Column) -> Column:
    short = F.length(F.substring_index(own, "E", 1)) <= 16
    unpadded = F.when(own.endswith("0") & ~own.endswith(".0"), F.regexp_replace(own, r"(\.\d+?)0+$", "$1")).otherwise(own)
    named = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v == 0)
    return F.when(named, own).when(short & ~own.contains("E"), unpadded).otherwise(_bound(F.when(short, own).otherwise(_fewest(v)), _laid_out))


def _fewest(v: Column) -> Column:
    """Scientific form with the fewest digits of 15, 16 (rounded from 17 or directly) and 17."""
    if_equal = lambda f: F.when(f.cast("double") == v, f)
    longest = F.format_string("%.16E", v)
    forms = [F.format_string("%.14E", v), F.format_string("%.15E", v), F.regexp_replace(longest, r"\dE", "E")]  # the last rounds digits that are rounded already
    return F.coalesce(*[_bound(f, if_equal) for f in forms], longest)


def _laid_out(form: Column) -> Column:
    """A number in scientific form as Python writes it."""
    digits = F.rtrim(F.translate(F.substring_index(form, "E", 1), "-.", ""), F.lit("0"))
    parts = F.struct(
        F.when(form.startswith("-"), "-").otherwise("").alias("sign"),
        F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).alias("digits"),
        F.substring_index(form, "E", -1).cast("int").alias("power"),
    )

    def written(x: Column) -> Column:
        digits, power = x["digits"], x["power"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        whole = F.rpad(F.left(digits, power + 1), power + 1, F.lit("0"))
        fraction = F.when(F.length(digits) > power + 1, F.substring(digits, power + 2, F.length(digits))).otherwise("0")
        more = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise("")
        size = F.abs(power).cast("string")
        long = F.concat(F.left(digits, F.lit(1)), more, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        return F.concat(x["sign"], F.when(power.between(-4, -1), small).when(power.between(0, 15), F.concat(whole, F.lit("."), fraction)).otherwise(long))

    return _bound(parts, written)


def canonical_text(value: Column | str, kind: T.DataType | str, *, compact: bool = False, drop_nulls: bool = False) -> Column:
    """A value of any type (`kind`: its type or DDL) as JSON: keys sorted at every depth, nulls written out, texts and numbers as in `quoted` and `double_text`.

    `compact`: no space after commas and colons. `drop_nulls`: members of
    structs, maps and variants that are null are left out, at every depth;
    entries of arrays stay. Whole numbers have no point, decimals count as
    doubles, dates and times are strings. A null value is `null`. Values of types that
    hold a VARIANT are written by Python in batches, others on the JVM.
    """
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if _holds_variant(kind):
        write = _variant_text(compact, drop_nulls)
        return F.coalesce(write(F.to_json(F.struct(_c(value).alias("v")), {"ignoreNullFields": "false"})), F.lit("null"))
    return _bound(_c(value), lambda v: _text(v, kind, (",", ":") if compact else (", ", ": "), drop_nulls))


def _holds_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _holds_variant(kind.valueType)
    return _holds_variant(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.VariantType)


def _text(v: Column, kind: T.DataType, marks: tuple[str, str], drop: bool) -> Column:
    return F.when(v.isNull(), "null").otherwise(_body(v, kind, marks, drop))


def _body(v: Column, kind: T.DataType, marks: tuple[str, str], drop: bool) -> Column:
    comma, colon = marks
    if isinstance(kind, T.StructType):
        members = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            own, name = v.getField(f.name), F.lit(json.dumps(f.name, ensure_ascii=False) + colon)
            members.append(F.when(own.isNotNull(), F.concat(name, _body(own, f.dataType, marks, drop))) if drop else F.concat(name, _text(own, f.dataType, marks, drop)))
        return F.concat(F.lit("{"), F.concat_ws(comma, *members), F.lit("}"))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(v)
        if drop:
            entries = F.filter(entries, lambda e: e["value"].isNotNull())
        entries = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(colon), _text(e["value"], kind.valueType, marks, drop))), comma), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: _text(x, kind.elementType, marks, drop)), comma), F.lit("]"))
    if isinstance(kind, T.BooleanType | T.IntegralType):
        return v.cast("string")
    return double_text(v) if isinstance(kind, T.FractionalType) else quoted(v.cast("string"))


def _variant_text(compact: bool, drop_nulls: bool):
    @F.pandas_udf(T.StringType())
    def write(values: pd.Series) -> pd.Series:
        def kept(x: object) -> object:
            if isinstance(x, dict):
                return {k: kept(v) for k, v in x.items() if v is not None or not drop_nulls}
            return [kept(v) for v in x] if isinstance(x, list) else x

        separators = (",", ":") if compact else (", ", ": ")
        return values.map(lambda t: json.dumps(kept(json.loads(t)["v"]), ensure_ascii=False, sort_keys=True, separators=separators), na_action="ignore").astype("object")

    return write


def strip_null_fields(value: Column | str, kind: T.DataType | str) -> Column:
    """A value as compact JSON without its null members, at every depth; a null value is `null`."""
    return canonical_text(value, kind, compact=True, drop_nulls=True)


def json_array(values: list[Column]) -> Column:
    parts: list[Column] = []
    for i, v in enumerate(values):
        parts += [F.lit("[" if i == 0 else ", "), quoted(v)]
    return F.concat(*parts, F.lit("]"))


def stable_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def is_even_digest(digest: Column | str) -> Column:
    """Whether a hexadecimal digest is an even number."""
    return F.instr(F.lit("02468ace"), F.right(_c(digest), F.lit(1))) > 0


def parse_span_markup(text: Column | str) -> Column:
    """`<v>...</v>` markup as struct<valid, clean, spans array<struct<start, end, text>>>; offsets in code points of the clean text.

    Nested, unbalanced or crossing marks: valid is false, clean and spans are null.
    """
    t = _c(text)
    parts = F.split(t, "</?v>", -1)
    tags = F.regexp_extract_all(t, F.lit("(</?v>)"), F.lit(1))
    n = F.size(tags)
    ordered = F.forall(
        F.zip_with(tags, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda tag, i: tag.isNull() | (tag == F.when(i % 2 == 0, "<v>").otherwise("</v>"))),
        lambda x: x,
    )
    valid = (n % 2 == 0) & ((n == 0) | ordered)
    lengths = F.transform(parts, lambda p: F.length(p))
    upto = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    inner = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    spans = F.transform(
        inner,
        lambda i: F.struct(upto(i).cast("int").alias("start"), (upto(i) + F.get(lengths, i)).cast("int").alias("end"), F.get(parts, i).alias("text")),
    )
    return F.when(
        t.isNotNull(),
        F.struct(valid.alias("valid"), F.when(valid, F.array_join(parts, "")).alias("clean"), F.when(valid, spans).alias("spans")),
    )


# The metadata of a case and what stands for each that is missing.
CASE_METADATA = {
    "source_case_id": None, "candidate_role": None, "language_pair": "unknown", "origin_suite": "unknown", "partition": "unspecified",
    "gold_mode": "unknown", "gold_verdict": "unknown", "gold_severity": "unknown", "gold_category": "unknown", "phenomenon": "unknown",
}


def case_metadata_defaults(role: Column | str, fields: dict[str, Column | str]) -> Column:
    """struct of a case's ten metadata fields for one of its candidates; `fields` gives columns by field, those missing or null take the default."""
    given = {**fields, "candidate_role": role}
    missing = lambda n: F.lit(CASE_METADATA[n]).cast("string")
    return F.struct(*[(F.coalesce(_c(given[n]).cast("string"), missing(n)) if n in given else missing(n)).alias(n) for n in CASE_METADATA])


def safe_rate(numerator: Column | str, denominator: Column | str) -> Column:
    """The ratio to six places, halves to even; null over zero."""
    return F.bround(_c(numerator).cast("double") / F.nullif(_c(denominator), F.lit(0)).cast("double"), 6)


def scorer_text(source: Column | str, candidate: Column | str, reference: Column | str | None = None) -> Column:
    parts = [F.lit("source: "), _c(source), F.lit(" candidate: "), _c(candidate)]
    if reference is not None:
        r = _c(reference)
        parts.append(F.when(r.isNotNull(), F.concat(F.lit(" reference: "), r)).otherwise(""))
    return F.concat(*parts)


def judge_request_text(mode: Column | str, case_input: dict[str, Column]) -> Column:
    """The evaluation mode and the case's input as JSON with sorted keys."""
    return F.concat(F.lit("Evaluation mode: "), _c(mode), F.lit("\n"), canonical_json(case_input))


def utc_timestamp(value: Column | str) -> Column:
    """An ISO timestamp as an instant; without an offset it is UTC."""
    v = _c(value)
    stamped = F.when(v.rlike(r"(Z|[+-]\d\d:?\d\d)$"), v).otherwise(F.concat(v, F.lit("Z")))
    return F.to_timestamp(stamped)


def run_window(finished: Column, elapsed_seconds: Column) -> Column:
    """struct<started, finished, stamp>: the start that the elapsed time gives, and the finish as yyyyMMdd'T'HHmmss'Z'."""
    started = F.timestamp_micros(F.unix_micros(finished) - F.round(elapsed_seconds * 1000000).cast("long"))
    return F.struct(started.alias("started"), finished.alias("finished"), F.date_format(finished, "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))
