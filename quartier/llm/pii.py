"""Personal data by candidate gradient boosting. DataFrame and SQL functions only."""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import id_text, text_or_empty
from quartier.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Documents (by hash of doc_id, in expectation) that the trees take two thirds of; trees, depth, seed.
SAMPLE, TREES, DEPTH, SEED = 20_000, 12, 3, 3
#: Share of rule-true spans that a calibrated threshold must reach among the candidates above it; candidates it takes at least.
PRECISION, LEAST = 0.95, 30
#: Code points of context, and matches per block of a running sum.
CONTEXT, BLOCK = 24, 512

# The base patterns. Possessive loops match the same strings without a stack frame per repetition; an address's local
# part starts at the start of its run or where the match before ended, as the leftmost match does.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: what the base leaves out as well as what it takes. An address's local part has at most 64
# characters in the mail standard; longer ones are the rules' only.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[.,]\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,19}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,15}(?![0-9A-Za-z])",
}
#: What a text needs for a kind at all: a cheap test before the patterns.
_NEEDS = {
    "email": (r"@", r"@|[(\[]at[)\]]|\x20at\x20"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9]\x20?[.,]\x20?[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20./-]?[0-9]){11}"),
    "phone": (r"\+[0-9]", r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"),
}


def _struct(**fields: Column) -> Column:
    """A struct whose names hold inside lambda functions too."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def _running(lengths: Column, start: Column) -> Column:
    """Starts of spans whose gap and size are g and n, one after the other from ``start``."""
    return F.aggregate(
        lengths,
        _struct(at=start, out=F.array().cast("array<long>")),
        lambda acc, x: _struct(at=acc["at"] + x["g"] + x["n"], out=F.array_append(acc["out"], acc["at"] + x["g"])),
        lambda acc: acc["out"],
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambda functions in the body use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(spans: Column) -> Column:
    """Starts of spans (g code points after the one before, n long), by sums of blocks and then within each block."""
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x["g"] + x["n"])
    blocks = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), lambda i: F.slice(spans, i, BLOCK))
    return _let(
        blocks,
        lambda b: F.flatten(F.zip_with(b, _running(F.transform(b, lambda x: _struct(g=F.lit(0).cast("long"), n=total(x))), F.lit(0).cast("long")), _running)),
    )


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, found, before, after>> of all leftmost matches; positions in code points.

    What lies between matches comes from a split by the same pattern, so positions are sums of lengths, taken block by
    block: the work stays near the number of matches.
    """
    read = _struct(between=F.split(text, pattern, -1), found=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def spans(r: Column) -> Column:
        n = F.size(r["found"])
        placed = F.zip_with(F.slice(r["between"], F.lit(1), n), r["found"], lambda b, f: _struct(g=F.length(b).cast("long"), n=F.length(f).cast("long")))
        around = F.zip_with(
            F.slice(r["between"], F.lit(1), n), F.slice(r["between"], F.lit(2), n),
            lambda b, a: _struct(before=F.right(b, F.lit(CONTEXT)), after=F.left(a, F.lit(CONTEXT))),
        )
        whole = F.zip_with(r["found"], around, lambda f, c: _struct(found=f, before=c["before"], after=c["after"]))
        starts = _let(placed, _starts)
        return F.when(n > 0, F.zip_with(starts, whole, lambda s, w: _struct(start=s, found=w["found"], before=w["before"], after=w["after"])))

    empty = F.array().cast("array<struct<start:bigint,found:string,before:string,after:string>>")
    return F.coalesce(F.when(F.rlike(text, F.lit(needs)), _let(read, spans)), empty)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of 13 to 19 digits ends in 0."""
    summed = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(F.reverse(digits), i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(F.reverse(digits), i, F.lit(1)).cast("int") + 1)
        ),
    )
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), summed % 10 == 0).otherwise(False)


def _valid(kind: str, found: Column) -> Column:
    """The rule of a base kind."""
    if kind == "ip":  # any number of leading zeros
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(
            F.split(found, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(999)) <= 255
        )
    if kind == "card":
        return _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _numbered(array: Column, k: int, valid=None) -> Column:
    """(kind number, start, end) of spans."""
    kept = F.filter(array, lambda s: valid(s["found"])) if valid else array
    return F.transform(kept, lambda s: _struct(k=F.lit(k), s=s["start"], e=s["start"] + F.length(s["found"])))


def span_text(spans: Column) -> Column:
    """kind:start:end of (k, s, e), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _rule_spans(text: Column) -> list[Column]:
    """The rules' spans of each kind, in order."""
    return [_numbered(_matches(text, BASE[k], _NEEDS[k][0]), i, lambda f, k=k: _valid(k, f)) for i, k in enumerate(KINDS)]


def base_spans(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, spans (array of k, s, e by kind, then start) of the rule-based kinds; with ``text`` the texts too, for ``redact``."""
    found = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", F.concat(*_rule_spans(F.col("text"))).alias("spans"))
    return found if text else found.drop("text")


def _last_before(spans: Column, e: Column) -> Column:
    """The last of sorted ``spans`` that starts before ``e``, found by halving; null where none does."""
    n = F.size(spans)
    top = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    halves = F.transform(F.sequence(F.lit(0), top), lambda j: F.pow(F.lit(2), top - j).cast("int"))
    step = lambda at, d: F.when((at + d <= n) & (F.get(spans, at + d - 1)["s"] < e), at + d).otherwise(at)
    return F.get(spans, F.aggregate(halves, F.lit(0), step) - 1)


def _marked(wide: Column, bases: list[Column]) -> Column:
    """Candidates with label (1 for a rule's span of their kind) and meets (whether one meets a rule's span).

    A kind's spans are sorted and apart, so only the last one that starts before a candidate ends can meet it.
    """
    def of(c: Column) -> Column:
        lasts = _struct(**{f"l{i}": _last_before(b, c["e"]) for i, b in enumerate(bases)})

        def told(last: Column) -> Column:
            own = lambda i: (c["k"] == i) & (last[f"l{i}"]["s"] == c["s"]) & (last[f"l{i}"]["e"] == c["e"])
            either = lambda tests: F.coalesce(tests[0], F.lit(False)) if len(tests) == 1 else F.coalesce(tests[0], F.lit(False)) | either(tests[1:])
            n = range(len(bases))
            return _struct(
                **{f: c[f] for f in ("k", "s", "e", "found", "before", "after")},
                label=either([own(i) for i in n]).cast("double"), meets=either([last[f"l{i}"]["e"] > c["s"] for i in n]),
            )

        return _let(lasts, told)

    return F.transform(wide, of)


def candidates(text: Column) -> Column:
    """array<struct<k, s, e, found, before, after>> of all spans that the wide generators propose. They may overlap."""
    def of(i: int, kind: str) -> Column:
        return F.transform(
            _matches(text, WIDE[kind], _NEEDS[kind][1]),
            lambda m: _struct(
                k=F.lit(i), s=m["start"], e=m["start"] + F.length(m["found"]), found=m["found"], before=m["before"], after=m["after"]
            ),
        )

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)])


def with_features(rows: DataFrame) -> DataFrame:
    """Adds ``features``: the candidate's format and context, but not the marks by which the rules tell their spans (a
    leading plus, an at sign), so that like spans without them can be told too."""
    found, digits = F.regexp_replace("found", r"^\+", ""), _digits(F.col("found"))
    before, after = F.lower("before"), F.lower("after")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    is_in = lambda c, p: F.rlike(c, F.lit(p)).cast("double")
    features = [
        *[(F.col("k") == i).cast("double") for i in range(len(KINDS))],
        F.length(found), F.length(digits), count(found, "[0-9]+"), count(found, r"\."), count(found, "-"), count(found, r"\x20"), count(found, "[()]"),
        F.length(F.regexp_extract(found, "^[^0-9A-Za-z]*([0-9A-Za-z]+)", 1)), F.length(F.regexp_extract(found, "([0-9A-Za-z]+)[^0-9A-Za-z]*$", 1)),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0)),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0)), lambda x: F.right(x, F.lit(9)).cast("int"))), F.lit(0)),
        is_in(found, r"(?i)[.](com|org|net|edu|gov|io|de|fr|es|uk|example)$"), is_in(found, r"^[A-Za-z]+[._-]"), F.when(F.col("k") == 2, _luhn(digits).cast("double")).otherwise(0.0),
        is_in(before, r"[a-z0-9_]$"), is_in(before, r"[\x20\n]$"), is_in(before, r"[=:\"'#$/]\x20?$"), is_in(before, r"(mail|contact|write|at)\W*$"),
        is_in(before, r"(tel|phone|call|fax|mobile|cell)\W*$"), is_in(before, r"(card|visa|credit|account|no)\W*$"), is_in(before, r"(version|ver|v|release|page|isbn|license|clause)\W*$"),
        is_in(before, "[0-9]"), is_in(after, r"^[a-z0-9_]"), is_in(after, r"^[\x20\n,.;]"), is_in(after, "[0-9]"), is_in(after, r"^\x20?[%$€/=]"),
    ]
    return rows.withColumn("features", array_to_vector(F.array(*[f.cast("double") for f in features])))


def read_spans(docs: DataFrame, text: bool = False) -> DataFrame:
    """uid, doc_id, h (hash), base and wide (candidates with label, 1 for a rule's span, and meets, whether one meets a base span);
    with ``text`` the texts too."""
    rules = {f"b{i}": spans for i, spans in enumerate(_rule_spans(F.col("text")))}
    both = _let(
        _struct(**rules, wide=candidates(F.col("text"))),
        lambda r: _struct(base=F.concat(*[r[b] for b in rules]), wide=_marked(r["wide"], [r[b] for b in rules])),
    )
    h = F.pmod(F.xxhash64(id_text()), F.lit(1_000_000))
    rows = docs.select("doc_id", h.alias("h"), text_or_empty().alias("text"))
    kept = ["text"] if text else []
    return materialise(rows.select("doc_id", "h", *kept, both.alias("r"), F.monotonically_increasing_id().alias("uid"))).select(
        "doc_id", "uid", "h", *kept, "r.base", "r.wide"
    )


def fit_spans(read: DataFrame, sample: int = SAMPLE):
    """(trees, threshold by kind) from the candidates of ``read``, or (None, {}) where one class is missing.

    A candidate is true where it is a rule's span. Trees are fitted on two thirds of about ``sample`` documents. On all
    other documents each kind's threshold is the least chance above which at least PRECISION of the candidates are true.
    Only candidates and counts by level of chance leave the tasks; the driver gets one row per kind and level.
    """
    share = min(1.0, sample / max(read.count(), 1))
    held = (F.col("h") >= int(share * 1_000_000)) | (F.col("h") % 3 == 0)
    given = read.select(held.alias("held"), F.explode("wide").alias("c")).select("held", "c.*")
    fit = with_features(given.where("NOT held"))
    if fit.select("label").distinct().count() < 2:
        return None, {}
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(fit.select("label", "features"))
    held = trees.transform(with_features(given.where("held"))).select("k", "label", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("level"))
    levels: dict[int, list] = {}
    for r in held.groupBy("k", "level").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect():
        levels.setdefault(r["k"], []).append((r["level"], r["good"], r["n"]))
    limits = {}
    for k, steps in levels.items():
        good = n = 0
        for level, g, c in sorted(steps, reverse=True):
            good, n = good + g, n + c
            if n >= LEAST and good >= PRECISION * n:
                limits[k] = level / 100
    return trees, limits


def find_spans(docs: DataFrame, sample: int = SAMPLE, text: bool = False) -> DataFrame:
    """doc_id, base, spans (with ``text`` the texts too, for ``redact``) of every row of ``docs``: arrays of (k, s, e) by kind, then start; k numbers KINDS, s and e are code points.

    ``base`` are the rules' spans, all of which are among ``spans``. Added are candidates of the wide generators that the
    trees score at or above their kind's calibrated threshold and that meet no base span and no better
    candidate's start. A null text is empty; empty texts have no spans. Repeated rows get equal spans; extra columns are
    not used; an empty table gives an empty result. Texts are not shuffled: added spans return to their row by a number.
    """
    # one read: the rules' spans and all candidates
    read = read_spans(docs, text)
    own = ["doc_id", *(["text"] if text else []), "base"]
    trees, limits = fit_spans(read, sample)
    if not limits:
        return read.select(*own, F.col("base").alias("spans"))
    limit = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("k"))
    scored = trees.transform(with_features(read.select("uid", F.explode("wide").alias("c")).select("uid", "c.*").where("NOT meets")))
    scored = scored.withColumn("chance", vector_to_array("probability")[1]).where(F.col("chance") >= limit)
    # of candidates for the same place the best chance stays
    best = scored.groupBy("uid", "s").agg(F.max(F.struct("chance", "k", "e")).alias("b"))
    added = best.groupBy("uid").agg(F.collect_list(F.struct("b.k", "s", "b.e")).alias("added"))
    joined = read.join(added, "uid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<k:int,s:bigint,e:bigint>>"))))
    return joined.select(*own, spans.alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """doc_id, text of every row of ``found`` (doc_id, text, spans), each span replaced by its kind in brackets.

    Overlapping spans are replaced once, from the first one's start to the last one's end. Spans stand on their row, so
    rows may share a doc_id or have none; a null text is empty.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda x: _struct(s=x["s"], e=x["e"], k=x["k"])))
    start = _struct(at=F.lit(0).cast("long"), parts=F.array().cast("array<string>"))

    def step(acc, x):
        piece = F.when(
            x["s"] >= acc["at"],
            F.array_append(F.array_append(acc["parts"], F.substring("_t", (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))), F.get(names, x["k"])),
        ).otherwise(acc["parts"])
        return _struct(at=F.greatest(acc["at"], x["e"]), parts=piece)

    text = F.aggregate(
        ordered, start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("_t", (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return found.select("doc_id", text_or_empty().alias("_t"), "spans").select("doc_id", text.alias("text"))
