"""The format-string language: text, ``%TOKEN`` and a ``[...]`` loop over the samples.

Tokens outside a loop are fields of the record, inside it fields of the call first. ``\\t`` and
``\\n`` are understood; a null prints as a dot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"%(?P<token>(?:INFO/)?[A-Za-z_][A-Za-z0-9_]*)(?:\{(?P<index>\d+)\})?|(?P<open>\[)|(?P<close>\])|(?P<text>[^%\[\]]+|%)")
RECORD = {"CHROM": "chrom", "POS": "pos", "ID": "id", "REF": "ref", "ALT": "alt", "QUAL": "qual", "FILTER": "filter"}
CALL = {"GT": "gt", "DP": "dp", "SAMPLE": "sample_id"}


class FormatError(ValueError):
    pass


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def _each_call(calls: str, parts: list[tuple[str, str, str | None]], of_record) -> Column:
    def one(c: Column) -> Column:
        return F.concat(*(F.lit(t) if k == "text" else _shown(c[CALL[t]]) if t in CALL else of_record(t, i) for k, t, i in parts))

    return F.array_join(F.transform(calls, one), "")


def compile_format(text: str, fields: dict[str, str], calls: str = "calls") -> Column:
    """One string column; ``fields`` adds names of record columns to the usual ones."""
    record = RECORD | fields
    text = text.replace("\\t", "\t").replace("\\n", "\n")
    outside: list[Column] = []
    loop: list[tuple[str, str, str | None]] | None = None

    def of_record(token: str, index: str | None) -> Column:
        name = token.removeprefix("INFO/")
        if name not in record:
            raise FormatError(f"no field {token}")
        column = F.col(record[name])
        return _shown(F.get(F.split(column.cast("string"), ","), F.lit(int(index))) if index is not None else column)

    for match in _PART.finditer(text):
        kind = "token" if match["token"] else match.lastgroup
        if kind == "open":
            if loop is not None:
                raise FormatError("loops can't be nested")
            loop = []
        elif kind == "close":
            if loop is None:
                raise FormatError("] without [")
            outside.append(_each_call(calls, loop, of_record))
            loop = None
        elif loop is not None:
            loop.append((kind, match["token"] or match["text"], match["index"]))
        else:
            outside.append(F.lit(match["text"]) if kind == "text" else of_record(match["token"], match["index"]))
    if loop is not None:
        raise FormatError("[ without ]")
    return F.concat(*outside) if outside else F.lit("")
