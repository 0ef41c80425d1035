"""Tag and metadata filters: a dict of conditions becomes one predicate.

All conditions must hold. ``tag`` and ``tags`` look at the tags, every other
key is a path into the JSON metadata and is compared by type: the number 2024
does not match the string "2024".
"""

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``metadata_path`` accepts, as one pattern.
PATH_RULE = r"""^[^.\[\]'"\\]+(\.?[^.\[\]'"\\]+|\[[0-9]+\])*$"""
_SEGMENT = re.compile(r"""\.?(?P<name>[^.\[\]'"\\]+)|\[(?P<index>\d+)\]""")


def metadata_path(key: str) -> str:
    """``a.b[1]`` -> ``$['a']['b'][1]``; anything else is an error."""
    path, at = "$", 0
    while at < len(key):
        part = _SEGMENT.match(key, at)
        if part is None or (at == 0 and key[0] in ".["):
            raise ValueError(f"invalid metadata path: {key!r}")
        path += f"['{part['name']}']" if part["name"] is not None else f"[{part['index']}]"
        at = part.end()
    if path == "$":
        raise ValueError("empty metadata path")
    return path


def has_tags(wanted: list[str], tags="tags") -> Column:
    """Every wanted tag is present, compared exactly."""
    return reduce(and_, (F.array_contains(tags, t) for t in wanted), F.lit(True))


def _metadata_equals(key: str, value, metadata) -> Column:
    found = F.try_variant_get(F.try_parse_json(metadata), metadata_path(key), "variant")
    kind = F.schema_of_variant(found)
    number = F.try_variant_get(found, "$", "double")
    is_number = ~kind.rlike("^(STRING|BOOLEAN|VOID|ARRAY|OBJECT)")

    if isinstance(value, bool):
        # true equals the number 1 and false the number 0
        return ((kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(value))) | (
            is_number & (number == float(value))
        )
    if isinstance(value, (int, float)):
        same = is_number & (number == float(value))
        if isinstance(value, int) and abs(value) >= 2**53:
            same &= F.try_variant_get(found, "$", "decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)")
        if value in (0, 1):
            same |= (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(value == 1))
        return same
    # Text: a JSON string, or an array/object by its compact JSON. A null
    # filter is the text "null", which JSON null itself is not.
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string") == F.lit(text)).when(
        kind.rlike("^(ARRAY|OBJECT)"), F.to_json(found) == F.lit(text)
    )


def filter_column(filters: dict | None, tags="tags", metadata="metadata") -> Column:
    """Predicate for a filter dict; rows without the field never match."""
    conditions = []
    for key, value in (filters or {}).items():
        if key == "tag":
            if not isinstance(value, str):
                raise TypeError("filter 'tag' takes one string")
            conditions.append(has_tags([value], tags))
        elif key == "tags":
            if not isinstance(value, (str, list, tuple)):
                raise TypeError("filter 'tags' takes a string or a list of strings")
            wanted = [value] if isinstance(value, str) else [t for t in value if isinstance(t, str)]
            conditions.append(has_tags(wanted, tags))
        else:
            conditions.append(_metadata_equals(key, value, metadata))
    if not conditions:
        return F.lit(True)
    return F.coalesce(reduce(and_, conditions), F.lit(False))
