"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def camel_case(text: Column | str) -> Column:
    """``make-some_name`` to ``makeSomeName``; letters inside words keep their case."""
    parts = F.split(_col(text), r"[-_\s]+")
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))


def snake_case(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_col(text), "([A-Z])", "_$1")), "^_", "")


def queue_name(identifier: Column | str) -> Column:
    """Short name of a queue given as resource name, URL or dotted topic."""
    c = _col(identifier)
    last = lambda sep: F.element_at(F.split(c, sep), -1)
    return (
        F.when(c.startswith("arn:aws:sqs:"), last(":"))
        .when(c.contains("sqs.") & c.contains("amazonaws.com"), last("/"))
        .when(c.contains("."), last(r"\."))
        .otherwise(c)
    )


def api_path(identifier: Column | str) -> Column:
    """Path of a URL (``/`` when empty); other text unchanged."""
    c = _col(identifier)
    is_url = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(is_url, F.when(path == "", "/").otherwise(path)).otherwise(c)


def without_verb(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"^(GET|POST|PUT|DELETE|PATCH)\s+", "")


def table_name(identifier: Column | str) -> Column:
    c = _col(identifier)
    return F.when(c.contains("."), F.element_at(F.split(c, r"\."), -1)).otherwise(c)


def has_variable(identifier: Column | str) -> Column:
    return _col(identifier).contains("$")


def brace_path(path: Column | str) -> Column:
    """``/a/:id`` to ``/a/{id}``."""
    return F.regexp_replace(_col(path), r":(\w+)", "{$1}")


def operation_id(method: Column | str, path: Column | str) -> Column:
    """Verb and path words joined by underscores, ``root`` for the empty path."""
    words = F.filter(F.split(F.regexp_replace(_col(path), "[{}:]", ""), "/"), lambda p: p != "")
    joined = F.when(F.size(words) == 0, "root").otherwise(F.array_join(words, "_"))
    return F.concat_ws("_", F.lower(_col(method)), joined)


def property_map(json_text: Column | str) -> Column:
    """Properties from JSON text; anything unreadable is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(_col(json_text), "map<string,string>"), empty)
