"""The library's expressions as functions of SQL, and its queries as views.

Each function is a SQL expression that the optimizer inlines, so `spark.sql` has the same plans as the DataFrame functions and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({}, 0D, (s, y) -> s + y)"
_CLIP = "least(greatest({}, 1e-12D), 1D)"

#: name: (parameters, result, expression). Texts are taken as empty where they are null.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "normalize_text": ("t string", "string", r"trim(regexp_replace(lower(coalesce(t, '')), '(?U)\\s+', ' '))"),
    "text_hash": ("t string", "string", "md5(normalize_text(t))"),
    "text_tokens": ("t string", "array<string>", "regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+', 0)"),
    "pair_jaccard_distance": ("a string", "double", "1 - size(array_intersect(text_tokens(a), text_tokens(b))) / (size(array_union(text_tokens(a), text_tokens(b))) + 1e-9D)"),
    "pair_dice": ("a string", "double", "2 * size(array_intersect(text_tokens(a), text_tokens(b))) / (size(array_distinct(text_tokens(a))) + size(array_distinct(text_tokens(b))) + 1e-9D)"),
    "common_words": ("a string", "string", "array_join(array_sort(array_intersect(text_tokens(a), text_tokens(b))), ' ')"),
    "diff_words": ("a string", "string", "array_join(array_sort(array_union(array_except(text_tokens(a), text_tokens(b)), array_except(text_tokens(b), text_tokens(a)))), ' ')"),
    "vec_dot": ("a array<double>", "double", _SUM.format("zip_with(a, b, (x, y) -> x * y)")),
    "vec_norm": ("v array<double>", "double", f"sqrt({_SUM.format('transform(v, x -> x * x)')})"),
    "vec_cosine": ("a array<double>", "double", "vec_dot(a, b) / (vec_norm(a) * vec_norm(b) + 1e-12D)"),
    "vec_l1": ("a array<double>", "double", _SUM.format("zip_with(a, b, (x, y) -> abs(x - y))")),
    "vec_l2": ("a array<double>", "double", f"sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"),
    "vec_argmax": ("v array<double>", "bigint", "array_position(v, array_max(v)) - 1"),
    "vec_entropy": ("v array<double>", "double", "-" + _SUM.format(f"transform(v, x -> {_CLIP.format('x')} * ln({_CLIP.format('x')}))")),
    "vec_jsd": ("a array<double>", "double", _SUM.format(f"zip_with(transform(a, x -> {_CLIP.format('x')}), transform(b, x -> {_CLIP.format('x')}), (x, y) -> (x * ln(2 * x / (x + y)) + y * ln(2 * y / (x + y))) / 2)")),
    "safe_ratio": ("a double", "double", "a / (b + 1e-9D)"),
    "sigmoid": ("x double", "double", "1 / (1 + exp(-x))"),
    "logit_loss": ("x double", "double", "greatest(x, 0D) - x * y + ln(1 + exp(-abs(x)))"),
}
#: Functions of two values of one type; the others take one.
_SECOND = {"logit_loss": "y double"}


def _parameters(name: str) -> str:
    first = FUNCTIONS[name][0]
    return f"{first}, {_SECOND.get(name, 'b' + first[1:])}" if first.startswith("a ") or name in _SECOND else first


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (_, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({_parameters(name)}) returns {result} return {body}")
