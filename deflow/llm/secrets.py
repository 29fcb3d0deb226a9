"""Secrets in texts: three plain patterns, and random strings that a tokenizer's vocabulary cannot compress.

A vocabulary learned from ordinary text has long tokens for what people write and short ones for what
nobody writes. A run of letters and digits that takes a token for every ``RATIO`` characters or fewer is random.

1. Base patterns (``assign``, ``access``, ``hex``) are found leftmost and without overlap, each kind by itself;
   matches that are too short are dropped after they are found.
2. Runs of ``LEAST`` or more characters of the base64 alphabets are candidates. Known digests (hexadecimal of
   a usual digest's length, UUIDs), times, numbers and identifiers (words, in camel case or joined by marks, with
   digits behind them at most, of ``WORD`` letters on average) are excluded;
   what is left is counted in tokens, in pieces of ``PIECE`` characters, as a whole run can be very long.
3. A random run is reported as ``random`` unless a base span holds all of it; base spans always stay.

Defined results: a null or empty text has no span. Places are code points, ends exclusive. Spans are ordered by
start, then kind as in ``KINDS``. Rows that repeat are judged one by one; further columns are kept, and
new names that clash get an underscore.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deflow.llm import common

KINDS = ("assign", "access", "hex", "random")
LEAST = 16          # characters of a candidate
RATIO = 2.1         # characters a token at most for a random string
WORD = 3.0          # letters of an identifier's words on average, at least
PIECE = 256         # characters encoded together
SPANS = "array<struct<kind:string,start:int,end:int,ratio:double>>"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")     # runs are maximal, so the length can stand in the pattern
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}     # MD5, SHA-1, SHA-2
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:[T_-][0-9-]*Z?)?\Z")
_NAME = re.compile(r"(?:[A-Za-z]*[0-9]*[+/_=-])*[A-Za-z]*[0-9]*\Z")     # no letter behind a digit but for a mark between
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Whether ``run`` is a digest, a UUID, a time, a number or an identifier."""
    if len(run) in _DIGEST_LENGTHS and _DIGEST.match(run) or _UUID.match(run) or _TIME.match(run):
        return True
    if not _NAME.match(run):
        return False
    words = _WORDS.findall(run)
    return sum(map(len, words)) >= WORD * len(words)


def ratio(run: str, encoding: tiktoken.Encoding) -> float:
    tokens = sum(len(encoding.encode_ordinary(run[i:i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) / tokens


def base(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns: kind, start, end."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def spans(text: str | None, encoding: tiktoken.Encoding, most: float = RATIO) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text in order: kind, start, end, and the characters a token of random ones."""
    if not text:
        return []
    plain = base(text)
    out: list[tuple] = [(*s, None) for s in plain]
    before, at, reach = sorted(s[1:] for s in plain), 0, 0     # reach: the last end of the base spans that begin so far
    for m in _RUN.finditer(text):
        while at < len(before) and before[at][0] <= m.start():
            reach = max(reach, before[at][1])
            at += 1
        if m.end() <= reach or known(m[0]):
            continue
        r = ratio(m[0], encoding)
        if r <= most:
            out.append(("random", m.start(), m.end(), r))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_HELD: dict[str, tiktoken.Encoding] = {}


def scan(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, most: float = RATIO) -> DataFrame:
    """``keep`` columns (all by default) with spans: kind, start, end, ratio of each.

    ``path`` is a tiktoken vocabulary every worker can read, ``pattern`` its way of cutting texts.
    """
    keep = list(docs.columns) if keep is None else keep
    common.on_workers(docs)

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _HELD:
            _HELD[path] = vocabulary(path, pattern)
        for texts in batches:
            rows = [spans(t.as_py(), _HELD[path], most) for t in texts]
            flat = [s for r in rows for s in r]
            kind, start, end, r = (pa.array([s[i] for s in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64())))
            offsets = pa.array(common.offsets_of([len(r) for r in rows]), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([kind, start, end, r], names=["kind", "start", "end", "ratio"]))

    name, made = common.fresh(keep, "spans"), common.fresh(docs.columns, "_spans")
    # Only texts go to Python. Marked so that several uses do not evaluate it anew.
    return docs.withColumn(made, found.asNondeterministic()(docs[text])).select(*keep, F.col(made).alias(name))


def count_of(spans_: str, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")


def listed(spans_: str, plain: bool = False) -> Column:
    """``kind:start:end`` of all spans, or of the base ones, joined by commas."""
    held = F.filter(spans_, lambda s: s["kind"] != "random") if plain else F.col(spans_)
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
