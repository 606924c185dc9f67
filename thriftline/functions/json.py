"""Reduction of JSON texts of any shape: the recursion is what Spark's own functions lack, so these are Python UDFs.

They take rows in small batches, not in Arrow's: texts may be long, and a
worker's memory does not go with ten thousand of them.

Texts that are no JSON come back as they are; null stays null.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kept array items of pruning and truncating, length of strings, depth of objects.
PRUNED_ITEMS, TRUNCATED_ITEMS, STRING_CHARS, MAX_DEPTH = 20, 3, 100, 3
#: A blank, as Unicode has it.
BLANK = r"[\t-\r \x{85}\p{Z}]"
#: Bytes from which texts are truncated, keys by which an object is an error and stays whole.
TRUNCATED_BYTES, ERROR_KEYS = 5120, ("error", "errors")


def pruned(v):
    """Without nulls in objects; long arrays cut, with a note of what is missing."""
    if isinstance(v, dict):
        return {k: pruned(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        more = [f"... ({len(v) - PRUNED_ITEMS} more items)"] if len(v) > PRUNED_ITEMS else []
        return [pruned(x) for x in v[:PRUNED_ITEMS]] + more
    return v


def truncated(v, depth: int = 0):
    """Long strings and arrays cut, objects below a depth collapsed."""
    if isinstance(v, str) and len(v) > STRING_CHARS:
        return f"{v[:STRING_CHARS]}...({len(v)}chars)"
    if isinstance(v, list):
        more = [f"...+{len(v) - TRUNCATED_ITEMS} more"] if len(v) > TRUNCATED_ITEMS else []
        return [truncated(x, depth + 1) for x in (v[:TRUNCATED_ITEMS] if more else v)] + more
    if isinstance(v, dict):
        return {k: truncated(x, depth + 1) for k, x in v.items()} if depth < MAX_DEPTH else f"{{...{len(v)} keys}}"
    return v


def flattened(v, at: str = "") -> list[str]:
    """`path:value` of every leaf, a.b for keys and a[0] for items; blank strings go, blanks in others are collapsed."""
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in flattened(w, f"{at}.{k}" if at else k)]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in flattened(w, f"{at}[{i}]" if at else str(i))]
    if isinstance(v, str):
        v = " ".join(v.split())
        return [f"{at}:{v}"] if v else []
    return [] if v is None and not at else [f"{at}:{json.dumps(v)}"]


#: Fixed values of outlines: bytes from which a string's length is told, length of a date, keys of an object, depth.
OUTLINE_STRING, OUTLINE_DATE, OUTLINE_KEYS, OUTLINE_DEPTH = 50, 10, 16, 5


def outline(v, depth: int = 0, most: int = OUTLINE_DEPTH) -> str:
    """The types of a JSON value, a line for each key; of an array its first item and how many there are."""
    indent = "  " * depth
    if depth > most:
        return f"{indent}..."
    if v is None:
        return f"{indent}null"
    if isinstance(v, bool):
        return f"{indent}bool"
    if isinstance(v, (int, float)):
        return f"{indent}{'int' if isinstance(v, int) and -(2**63) <= v < 2**63 else 'float'}"
    if isinstance(v, str):
        size = len(v.encode("utf-8", "surrogatepass"))
        kind = f"string[{size}]" if size > OUTLINE_STRING else "url" if v.startswith("http") else "date?" if "-" in v and size == OUTLINE_DATE else "string"
        return f"{indent}{kind}"
    if isinstance(v, list):
        if not v:
            return f"{indent}[]"
        first = outline(v[0], depth + 1, most)
        return f"{indent}[\n{first}\n{indent}]" if len(v) == 1 else f"{indent}[{first.strip()}] ({len(v)})"
    if not v:
        return f"{indent}{{}}"
    lines, keys = [f"{indent}{{"], sorted(v)
    for i, key in enumerate(keys[:OUTLINE_KEYS]):
        told = outline(v[key], depth + 1, most)
        if isinstance(v[key], (dict, list)):
            lines += [f"{indent}  {key}:", told]
        else:
            lines.append(f"{indent}  {key}: {told.strip()}{',' if i < len(keys) - 1 else ''}")
    if len(keys) >= OUTLINE_KEYS:
        lines.append(f"{indent}  ... +{len(keys) - OUTLINE_KEYS} more keys")
    return "\n".join([*lines, f"{indent}}}"])


def string_leaves(v) -> list[str]:
    if isinstance(v, dict):
        return [x for w in v.values() for x in string_leaves(w)]
    if isinstance(v, list):
        return [x for w in v for x in string_leaves(w)]
    return [v] if isinstance(v, str) and len(v) >= 3 else []


def embedded(text: str) -> str | None:
    """The first JSON object inside a text with a banner."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def _mapped(f: Callable, kind: T.DataType = T.StringType()):
    def one(text: str | None):
        if text is None:
            return None
        try:
            return f(_value(text), text)
        except (ValueError, RecursionError):  # no JSON, or nested deeper than Python goes
            return text if isinstance(kind, T.StringType) else None

    return F.udf(one, kind, useArrow=False)


def minified(v) -> str:
    """Halves of surrogate pairs, which no text in Spark can hold, stay escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False, separators=(",", ":")))


def json_prune(c: Column) -> Column:
    return _mapped(lambda v, _: minified(pruned(v)))(c)


def json_truncate(c: Column) -> Column:
    """Minified, and truncated unless the text is small or the object tells of errors."""
    def made(v, text: str) -> str:
        whole = len(text.strip().encode("utf-8", "surrogatepass")) < TRUNCATED_BYTES or (isinstance(v, dict) and any(k in v for k in ERROR_KEYS))
        return minified(v if whole else truncated(v))

    return _mapped(made)(c)


def whole_json(c: Column) -> Column:
    """The text where all of it is one JSON value, else null. Spark's parser stops behind the first value and makes infinities of numbers beyond a double, so what it takes is read to the end."""
    whole = F.udf(lambda t: t if t is not None and _is_json(t) else None, T.StringType(), useArrow=False)
    return whole(F.when(F.try_parse_json(c).isNotNull(), c))


def _is_json(text: str) -> bool:
    try:
        IN_RANGE.decode(text)
    except ValueError:
        return False
    return True


def _in_range(text: str) -> float:
    if math.isinf(v := float(text)):
        raise ValueError(f"{text} is beyond a double")
    return v


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON")


IN_RANGE = json.JSONDecoder(parse_int=_in_range, parse_float=_in_range)
#: Whole numbers keep all their digits.
VALUE = json.JSONDecoder(parse_float=_in_range, parse_constant=_no_number)


def _value(text: str):
    return VALUE.decode(text)


def json_flat(c: Column) -> Column:
    """The flat form of a JSON text; of other texts the trimmed lines that are not blank, with | between."""
    flat = _mapped(lambda v, _: "|".join(flattened(v)))(whole_json(c))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    return F.coalesce(flat, F.array_join(lines, "|"))


def json_embedded(c: Column) -> Column:
    return F.udf(lambda t: None if t is None else embedded(t), T.StringType(), useArrow=False)(c)


def structure_preserved(before: Column, after: Column) -> Column:
    """Share of a JSON text's longer strings that another text still holds; 1 without any, or where it is no JSON."""

    def share(text: str | None, other: str | None) -> float:
        try:
            leaves = string_leaves(json.loads(text or ""))
        except ValueError:
            leaves = []
        return sum(x in (other or "") for x in leaves) / len(leaves) if leaves else 1.0

    return F.udf(share, T.DoubleType(), useArrow=False)(before, after)


def compact_json(c: Column) -> Column:
    """Minified, with sorted keys; blanks collapsed where it is no JSON."""
    v = F.try_parse_json(whole_json(c))
    return F.coalesce(F.to_json(v), F.trim(F.regexp_replace(c, f"{BLANK}+", " ")))


def json_types(c: Column, most: int = OUTLINE_DEPTH) -> Column:
    """The outline of a JSON text; null where it is none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else outline(json.loads(text, parse_constant=_no_number), 0, most)
        except ValueError:
            return None

    return F.udf(one, T.StringType(), useArrow=False)(c)


def json_outline(df: DataFrame, text: str) -> DataFrame:
    """One row: the schema that all JSON texts of a column fit."""
    return df.select(F.try_parse_json(whole_json(F.col(text))).alias("v")).agg(F.schema_of_variant_agg("v").alias("outline"))
