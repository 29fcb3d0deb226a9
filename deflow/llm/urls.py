"""URL filter: rules on hosts and paths first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts where neither neighbour is a letter or digit. One strict term rejects; so do soft terms when
at least ``MIN_SOFT`` different ones occur and their weights reach ``MIN_WEIGHT``.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no term, and is
allowed. Of rules that fit, the longest wins, and of equally long ones the one with the longer host, then a
block. Repeated rows are judged one by one; clashing column names get an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deflow.llm import common

MIN_SOFT = 2
MIN_WEIGHT = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(allow: bool, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(allow, host.lower(), slash + path)


RULES = (rule(True, "org/"), rule(False, "example.org/es/"), rule(False, "example.org/en/1"),
         rule(True, "com/fr/"), rule(False, "com/de/"))

# Own word list: term -> weight; strict terms are listed apart.
STRICT = ("casino", "porn", "xxx", "viagra", "warez", "escort", "spam", "malware", "phishing")
SOFT = {"cheap": 1.0, "pills": 1.5, "free": 1.0, "bets": 1.5, "bet": 1.0, "win": 1.0, "ads": 1.0, "track": 1.0,
        "adult": 1.5, "loans": 1.0, "poker": 1.5, "deal": 1.0, "click": 1.0, "farm": 0.5, "crack": 1.0, "torrent": 1.0}


def best_rule(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The rule that decides; walks the host's suffixes, so the number of rules does not matter."""
    found, at = None, 0
    while host:
        for r in by_host.get(host[at:], ()):
            if path.startswith(r.path) and (found is None or (len(r.text), len(r.host), not r.allow) > (len(found.text), len(found.host), not found.allow)):
                found = r
        at = host.find(".", at) + 1
        if not at:
            break
    return found


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str) -> set[str]:
    """The different terms that stand alone in ``text``."""
    if not len(a):
        return set()
    found = set()
    for end, term in a.iter(text):
        before, after = end - len(term), end + 1
        if (before < 0 or not _word(text[before])) and (after == len(text) or not _word(text[after])):
            found.add(term)
    return found


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge(pages: DataFrame, url: str = "url", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
          strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None,
          min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """``keep`` columns (all by default) with host, path, rule, verdict, strict_terms, soft_terms, weight."""
    soft = SOFT if soft is None else soft
    keep = list(pages.columns) if keep is None else keep
    host, path, verdict, fit_rule, strict_c, soft_c, weight_c = (common.fresh(keep, n) for n in ("host", "path", "verdict", "rule", "strict_terms", "soft_terms", "weight"))
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    source = pages.select(
        *[pages[c] for c in keep],
        F.translate(F.coalesce(F.regexp_extract(pages[url], split, 1), F.lit("")), _UPPER, _LOWER).alias(host),
        F.coalesce(F.regexp_extract(pages[url], split, 2), F.lit("")).alias(path))
    schema = T.StructType([
        *source.schema.fields, T.StructField(fit_rule, T.StringType()), T.StructField(verdict, T.StringType()),
        T.StructField(strict_c, T.ArrayType(T.StringType())), T.StructField(soft_c, T.ArrayType(T.StringType())),
        T.StructField(weight_c, T.DoubleType())])
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    strict_set, lower = set(strict), str.maketrans(_UPPER, _LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton([*strict, *soft])
        n = len(keep)
        for b in batches:
            rule_, verdict_, strict_, soft_, weight_ = [], [], [], [], []
            for h, p in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                found = hits(a, h + p.translate(lower))
                hard, weak = sorted(found & strict_set), sorted(found - strict_set)
                weight = sum(soft[t] for t in weak)
                r = best_rule(h, p, by_host)
                bad = bool(hard) or (len(weak) >= min_soft and weight >= min_weight)
                rule_.append(r.text if r else None)
                verdict_.append(("allow" if r.allow else "block") if r else ("block" if bad else "allow"))
                strict_.append(hard), soft_.append(weak), weight_.append(weight)
            words = pa.list_(pa.string())
            yield common.carry(b, [*keep, host, path], **{
                fit_rule: pa.array(rule_, pa.string()), verdict: pa.array(verdict_, pa.string()),
                strict_c: pa.array(strict_, words), soft_c: pa.array(soft_, words), weight_c: pa.array(weight_, pa.float64())})

    return common.on_workers(source).mapInArrow(run, schema)
