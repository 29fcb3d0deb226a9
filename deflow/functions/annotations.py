"""What a type annotation's text says about ``None``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names and generic prefixes known not to be None.
NONNULL_NAMES = ["str", "int", "float", "bool", "bytes", "bytearray", "list", "dict", "set", "tuple",
                 "frozenset", "object", "type", "complex"]
NONNULL_GENERICS = ["List", "Dict", "Set", "FrozenSet", "Tuple", "Sequence", "Iterable", "Iterator",
                    "Generator", "Callable", "Type", "Deque", "DefaultDict", "Counter", "ChainMap"]


def head_name(text: str) -> str:
    """SQL for the identifier before the first ``[`` or ``|``, without its module."""
    return f"regexp_extract(trim(regexp_extract({text}, r'^([^\\[|]*)', 1)), r'([^.]*)$', 1)"


def mentions_none(text: str) -> str:
    """SQL test for ``None``/``NoneType`` as a token of its own."""
    return f"({text} rlike r'(?<![A-Za-z0-9_])None(Type)?(?![A-Za-z0-9_])')"


def annotation_code(text: str) -> str:
    """SQL giving 3 nullable, 2 non-null, 0 no information for the annotation text expression."""
    t = f"regexp_replace({text}, r'^\\s+|\\s+$', '')"
    names = ", ".join(f"'{n}'" for n in NONNULL_NAMES)
    generics = "|".join(NONNULL_GENERICS)
    return f"""CASE
        WHEN {text} IS NULL THEN 0Y
        WHEN {t} IN ('None', 'NoneType') THEN 3Y
        WHEN {head_name(t)} = 'Optional' AND contains({t}, '[') THEN 3Y
        WHEN (({head_name(t)} = 'Union' AND contains({t}, '[')) OR contains({t}, '|')) AND {mentions_none(t)} THEN 3Y
        WHEN {t} IN ({names}) THEN 2Y
        WHEN {t} rlike r'^({generics})\\[' AND NOT {mentions_none(t)} THEN 2Y
        ELSE 0Y END"""


def annotation_nullability(column: str) -> Column:
    """Nullability name implied by the annotation in ``column``."""
    return F.expr(f"CASE {annotation_code(column)} WHEN 3Y THEN 'Nullable' WHEN 2Y THEN 'NonNull' ELSE 'Unknown' END")


_NONE = re.compile(r"(?<![A-Za-z0-9_])None(Type)?(?![A-Za-z0-9_])")
_GENERIC = re.compile(rf"({'|'.join(NONNULL_GENERICS)})\[")


def annotation_value(text: str | None) -> int:
    """What ``annotation_code`` gives, for code that runs beside the parser."""
    if text is None:
        return 0
    t = text.strip(" \t\n\x0b\f\r")
    if t in ("None", "NoneType"):
        return 3
    head = re.split(r"[\[|]", t, maxsplit=1)[0].strip(" ").rpartition(".")[2]
    if head == "Optional" and "[" in t:
        return 3
    none = _NONE.search(t) is not None
    if none and (head == "Union" and "[" in t or "|" in t):
        return 3
    return 2 if t in NONNULL_NAMES or not none and _GENERIC.match(t) else 0
