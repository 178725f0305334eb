"""Secret scans by linking the parts of a credential."""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quartier.llm.common import text_or_empty
from quartier.session import materialise

#: The rules' kinds, then those of weak candidates.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
RULES = 3
#: What a kind is of a credential: 0 an identifier, 1 a secret, 2 an endpoint.
PARTS = (1, 0, 1, 0, 1, 2)
#: Code points between two parts of one credential at most; fewest characters of the rules' spans.
REACH, LEAST = 200, (6, 20, 24)

_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"(?:password|passwd|secret|token|api_?key){_GIVEN}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter runs hold no longer one, so the bound may stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
# Weak generators: whether the pattern needs an assignment mark, and what else a match must hold.
_BOTH = re.compile(r"(?=.*[0-9])(?=.*[a-f])")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")
WEAK = (
    (3, True, re.compile(rf"(?:access[_-]?key[_-]?id|client[_-]?id|user(?:name|[_-]?id)?|login|account(?:[_-]?id)?){_GIVEN}[A-Za-z0-9._@+-]{{3,}}", re.I | re.A), None),
    (3, False, re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{8,}"), None),
    (4, True, re.compile(rf"(?:pwd|pass(?:phrase)?|secret|token|auth|key|credential|bearer){_GIVEN}[^\s\"'<>]{{4,}}", re.I | re.A), None),
    (4, False, re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"), _MIXED),
    (4, False, re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])"), _BOTH),
    (5, True, re.compile(r"(?<![A-Za-z])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{3,}"), None),
    (5, True, re.compile(rf"(?:host|endpoint|server|url|region){_GIVEN}[A-Za-z0-9][A-Za-z0-9._:/-]{{3,}}", re.I | re.A), None),
    (5, True, re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])"), None),
)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans, sorted."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST[0]]
    return sorted(found)


def weak_spans(text: str, rules: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all weak candidates that meet no span of the rules, sorted. They may overlap."""
    marked = "=" in text or ":" in text
    found = sorted({
        (m.start(), kind, m.end()) for kind, needs, pattern, holds in WEAK if marked or not needs
        for m in pattern.finditer(text) if holds is None or holds.match(m[0])
    })
    kept, last, i = [], 0, 0
    for s, k, e in found:  # both are sorted by start: one walk along the two
        while i < len(rules) and rules[i][0] < s:
            last, i = max(last, rules[i][2]), i + 1
        if last <= s and (i == len(rules) or rules[i][0] >= e):
            kept.append((s, k, e))
    return kept


def text_parts(text: str) -> list[int]:
    """Kind, start, end and scope, one after the other, of the rules' spans and the weak candidates by start.

    Scopes are what blank lines part. Texts without weak candidates need no scopes.
    """
    rules = rule_spans(text)
    weak = weak_spans(text, rules)
    borders = [m.start() for m in BLANK.finditer(text)] if weak else []
    return [x for s, k, e in sorted(rules + weak) for x in (k, s, e, bisect_right(borders, s))]


@F.pandas_udf(ArrayType(LongType()))
def _parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(text_parts)


def _struct(flat: Column) -> Column:
    """array<struct<s, k, e, scope>> of the flat numbers."""
    at = lambda i, j: F.get(flat, i * 4 + j)
    each = lambda i: F.struct(at(i, 1).alias("s"), at(i, 0).cast("int").alias("k"), at(i, 2).alias("e"), at(i, 3).alias("scope"))
    return F.when(F.size(flat) > 0, F.transform(F.sequence(F.lit(0), (F.size(flat) / 4 - 1).cast("int")), each)).otherwise(
        F.array().cast("array<struct<s:bigint,k:int,e:bigint,scope:bigint>>")
    )


def read_parts(docs: DataFrame) -> DataFrame:
    """doc_id, uid (a row's number) and parts (array of s, k, e, scope by start) of every row of ``docs``: one read of the texts."""
    rows = docs.select("doc_id", _parts(text_or_empty()).alias("flat"), F.monotonically_increasing_id().alias("uid"))
    return materialise(rows).select("doc_id", "uid", _struct(F.col("flat")).alias("parts"))


def part_links(read: DataFrame, reach: int = REACH) -> DataFrame:
    """uid, s, k, e of weak candidates and pk, ps, pe of each disjoint part of another sort within ``reach`` code points of the same scope.

    An interval join on bins of ``reach`` code points: a candidate meets the parts of the bins that its span, widened by
    the reach, covers. A bin holds a bounded number of parts, as each pattern's matches don't overlap, however many a text has.
    Texts without weak candidates have no links.
    """
    given = read.where(F.exists("parts", lambda p: p["k"] >= RULES)).select("uid", F.explode("parts").alias("p")).select("uid", "p.*")
    sort = lambda k: F.get(F.array(*[F.lit(x) for x in PARTS]), k)
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    left = given.where(F.col("k") >= RULES).withColumn("bin", bins(F.col("s") - reach, F.col("e") + reach))
    right = given.select("uid", "scope", F.col("k").alias("pk"), F.col("s").alias("ps"), F.col("e").alias("pe"), bins(F.col("s"), F.col("e")).alias("bin"))
    gap = F.greatest(F.col("ps") - F.col("e"), F.col("s") - F.col("pe"))
    met = left.join(right, ["uid", "scope", "bin"]).where((sort(F.col("k")) != sort(F.col("pk"))) & gap.between(0, reach))
    return met.select("uid", "s", "k", "e", "pk", "ps", "pe")


def linked_spans(read: DataFrame, reach: int = REACH) -> DataFrame:
    """uid and added (array of s, k, e): the weak candidates whose complementary parts are there.

    A weak identifier needs a secret, a weak secret an identifier: one of the rules' spans, or a weak one if an endpoint is
    linked too. An endpoint needs both an identifier and a secret. So nothing is added to texts without both, be they weak or
    the rules' own, and only the others are linked.
    """
    pk = F.col("pk")
    sort = F.get(F.array(*[F.lit(x) for x in PARTS]), pk)
    has = lambda part: F.exists("parts", lambda p: p["k"].isin([k for k, x in enumerate(PARTS) if x == part]))
    flags = part_links(read.where(has(0) & has(1)), reach).groupBy("uid", "s", "k", "e").agg(
        F.max((sort == 0).cast("int")).alias("id"), F.max((sort == 1).cast("int")).alias("secret"), F.max((sort == 2).cast("int")).alias("endpoint"),
        F.max(((pk < RULES) & (sort != 2)).cast("int")).alias("strong"),
    )
    whole = F.when(F.col("k") == 5, (F.col("id") == 1) & (F.col("secret") == 1)).otherwise(
        (F.col("id") + F.col("secret") > 0) & ((F.col("strong") == 1) | (F.col("endpoint") == 1))
    )
    return flags.where(whole).groupBy("uid").agg(F.collect_list(F.struct("s", "k", "e")).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of (s, k, e), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base, spans of every row of ``docs``: arrays of (s, k, e) by start, then kind; k numbers KINDS, positions are code points.

    ``base`` are the rules' spans, all of them among ``spans``; added are weak candidates with their complementary parts,
    which may overlap each other but meet no base span. A null text is empty; empty texts have no spans. Repeated rows get
    equal spans; extra columns are not used; an empty table gives an empty result. Only parts are shuffled, and only those
    of texts with a weak candidate, an identifier and a secret; one text's spans are one row.
    """
    read = read_parts(docs)
    base = F.transform(F.filter("parts", lambda p: p["k"] < RULES), lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k"), p["e"].alias("e")))
    joined = read.select("doc_id", "uid", base.alias("base")).join(linked_spans(read, reach), "uid", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return joined.select("doc_id", "base", spans.alias("spans"))
