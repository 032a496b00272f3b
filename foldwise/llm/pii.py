"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides on spans.

Candidates are the matches of a strict pattern per kind (some fail its check, such as the Luhn sum)
and of a looser one. Regex, gazetteer and context labelers vote on each. Expectation maximisation
over the counted vote patterns (at most 3^4 per kind) estimates the labelers' reliabilities; its
posteriors train a logistic regression over the counted span features, which decides on the looser
matches. Strict matches that fail their check train it too, but are never spans.

Everything that reads rows is a DataFrame expression. The patterns are written so that Java finds
what their plain forms find, in linear time and without deep recursion: runs are possessive, and a
match starts at a run's first character or where the last match ended.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40

# The strict pattern of each kind.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of 13 to 19 digits; shorter and longer chains fail the check in any case
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The looser pattern of each kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?"
    r"[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])",
}
# Gazetteers as patterns over the matched text.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
}
# Words that speak for or against a kind, shortly before the match.
SPEAKS_FOR = {
    "email": r"mail|contact|write|correo|courriel|schreib|@",
    "ip": r"\bip\b|address|server|host|client|login|adres|direcci",
    "card": r"card|visa|master|credit|debit|amex|pay|karte|tarjeta|carte",
    "phone": r"phone|\btel|call|mobile|fax|whatsapp|ruf|llam|appel",
}
SPEAKS_AGAINST = {
    "email": r"example of|regex|pattern",
    "ip": r"version|\bv$|release|section|chapter",
    "card": r"isbn|order|invoice|serial|hash|bestell|pedido|commande",
    "phone": r"isbn|version|order|invoice|serial|fig",
}
ABSTAIN, NO, YES = -1, 0, 1
VOTERS = ("strict", "loose", "gazetteer", "context")


@dataclass(frozen=True)
class PiiModel:
    """The final classifier: weights of a span's features per kind, and what EM found."""

    intercept: float
    weights: tuple[float, ...]
    reliabilities: dict[str, dict[str, float]]


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            back,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The check of a strict match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        trimmed = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(trimmed, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` of all matches; code points, end exclusive.

    The pieces between the matches give their places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def add(state: Column, both: Column) -> Column:
        begin = state["at"] + F.length(both["piece"])
        end = begin + F.length(both["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), both["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    paired = F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        matches,
        lambda p, m: F.struct(p.alias("piece"), m.alias("match")),
    )
    return F.aggregate(paired, start, add, lambda state: state["spans"])


_NONE = "array<struct<start:bigint,end:bigint,match:string>>"


def _guard(kind: str, text: Column) -> Column:
    """Texts without this hold no match of the kind, strict or loose."""
    marks = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"}
    return text.rlike(marks.get(kind, "[0-9]"))


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``(row, text, found)``: a document's columns, its text, and the matches and votes by kind."""
    docs = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = {}
    for kind in KINDS:
        guard = _guard(kind, text)
        found[f"_s_{kind}"] = F.when(guard, _found(text, STRICT[kind])).otherwise(F.array().cast(_NONE))
        found[f"_l_{kind}"] = F.when(guard, _found(text, LOOSE[kind])).otherwise(F.array().cast(_NONE))
    rows = docs.withColumns(found)

    def voted(kind: str, span: Column, strict: Column, loose: int) -> Column:
        first = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        width = (span["start"] - first).cast("int")
        before = F.lower(F.substring(text, first.cast("int") + 1, width))
        context = F.when(before.rlike(SPEAKS_AGAINST[kind]), NO).when(
            before.rlike(SPEAKS_FOR[kind]), YES
        )
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            strict.cast("int").alias("strict"),
            F.lit(loose).alias("loose"),
            F.when(span["match"].rlike(GAZETTEER[kind]), YES).otherwise(NO).alias("gazetteer"),
            F.coalesce(context, F.lit(ABSTAIN)).alias("context"),
        )

    spans = []
    for kind in KINDS:
        strict = F.transform(
            f"_s_{kind}",
            lambda s: voted(kind, s, F.coalesce(_passes(kind, s["match"]), F.lit(False)), ABSTAIN),
        )
        loose = F.transform(f"_l_{kind}", lambda s: voted(kind, s, F.lit(ABSTAIN), YES))
        apart = F.filter(
            loose,
            lambda x: ~F.exists(
                f"_s_{kind}", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])
            ),
        )
        spans.append(F.concat(strict, apart).alias(kind))
    return rows.select("row", "text", F.struct(*spans).alias("found"))


def _features(kind: str, span: Column) -> list[Column]:
    """Numbers the classifier reads: the kind, and what the labelers saw."""
    flags = [F.lit(float(kind == k)) for k in KINDS[1:]]
    for voter in VOTERS:
        flags += [(span[voter] == YES).cast("double"), (span[voter] == NO).cast("double")]
    return flags


def _expectation_maximisation(
    patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200
) -> tuple[list[float], dict[str, float]]:
    """Posterior of each counted vote pattern, and each labeler's accuracy where it votes."""
    total = sum(n for _, n in patterns)
    belief = []
    for votes, _ in patterns:
        cast = [v for v in votes if v != ABSTAIN]
        belief.append((sum(cast) + 1) / (len(cast) + 2))
    accuracy = [0.75] * len(VOTERS)
    for _ in range(rounds):
        prior = (sum(b * n for b, (_, n) in zip(belief, patterns, strict=True)) + 1) / (total + 2)
        for k in range(len(VOTERS)):
            right, seen = 3.0, 4.0
            for b, (votes, n) in zip(belief, patterns, strict=True):
                if votes[k] != ABSTAIN:
                    right += n * (b if votes[k] == YES else 1 - b)
                    seen += n
            accuracy[k] = min(0.99, max(0.51, right / seen))
        belief = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for a, v in zip(accuracy, votes, strict=True):
                if v != ABSTAIN:
                    odds += math.log(a / (1 - a)) * (1 if v == YES else -1)
            belief.append(1 / (1 + math.exp(-odds)))
    return belief, dict(zip(VOTERS, accuracy, strict=True))


def fit_pii(docs: DataFrame, text_col: str) -> PiiModel:
    """Learn from the votes on every candidate of ``docs``; only counted patterns leave the rows."""
    candidates = with_candidates(docs.select(F.col(f"`{text_col}`")), text_col)

    def tagged(kind: str) -> Column:
        def tag(span: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), *[span[v].alias(v) for v in VOTERS])

        return F.transform(f"found.{kind}", tag)

    counted = (
        candidates.select(F.explode(F.concat(*map(tagged, KINDS))).alias("c"))
        .groupBy("c.kind", *[f"c.{v}" for v in VOTERS])
        .agg(F.count("*").alias("n"))
    )
    rows = sorted((r.kind, tuple(r[v] for v in VOTERS), r.n) for r in counted.collect())
    reliabilities, weighted = {}, []
    for kind in KINDS:
        own = [(votes, n) for k, votes, n in rows if k == kind]
        if not own:
            continue
        belief, reliabilities[kind] = _expectation_maximisation(own)
        for b, (votes, n) in zip(belief, own, strict=True):
            flags = [float(kind == k) for k in KINDS[1:]]
            for v in votes:
                flags += [float(v == YES), float(v == NO)]
            weighted += [(flags, 1.0, n * b), (flags, 0.0, n * (1 - b))]
    if len({label for _, label, w in weighted if w > 0}) < 2:
        return PiiModel(-1.0, (0.0,) * (len(KINDS) - 1 + 2 * len(VOTERS)), reliabilities)
    heavy = sum(w for _, _, w in weighted) / len(weighted)
    small = docs.sparkSession.createDataFrame(
        [(f, y, w / heavy) for f, y, w in weighted], "flags array<double>, label double, weight double"
    ).coalesce(1)
    learner = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50
    )
    model = learner.fit(small.withColumn("x", array_to_vector("flags")))
    return PiiModel(float(model.intercept), tuple(map(float, model.coefficients)), reliabilities)


def find_pii(docs: DataFrame, model: PiiModel, text_col: str) -> DataFrame:
    """``(row, text, base, spans)``: ``row`` has the columns of ``docs``, the others are spans.

    Spans are ``array<struct<kind, start, end>>`` by kind and start. ``base`` are the strict matches
    that pass their checks. ``spans`` has them and the looser matches that the classifier takes for
    personal data and that overlap no strict match of their kind. NULL and empty texts have none; no other column is looked at, whatever its name; repeated
    rows stay.
    """
    rows = with_candidates(docs, text_col)
    base, spans = [], []
    for number, kind in enumerate(KINDS):

        def named(span: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end")
            )

        def accepted(span: Column) -> Column:
            margin = F.lit(model.intercept)
            for weight, flag in zip(model.weights, _features(kind, span), strict=True):
                margin = margin + weight * flag
            return (span["strict"] == YES) | ((span["loose"] == YES) & (margin > 0))

        own = F.col(f"found.{kind}")
        base.append(F.transform(F.filter(own, lambda s: s["strict"] == YES), named))
        spans.append(F.array_sort(F.transform(F.filter(own, accepted), named)))
    return rows.select(
        "row", "text", F.concat(*base).alias("base"), F.concat(*spans).alias("spans")
    )


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""

    def shown(span: Column) -> Column:
        places = [span[c].cast("string") for c in ("start", "end")]
        return F.concat_ws(":", span["kind"], *places)

    return F.array_join(F.transform(spans, shown), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlaps are replaced once."""
    fields = ("start", "end", "kind")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in fields])))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(state: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - state["at"], F.lit(0).cast("bigint"))
        kept = F.substring(text, (state["at"] + 1).cast("int"), gap.cast("int"))
        named = F.concat(F.lit("<"), span["kind"], F.lit(">"))
        mark = F.when(span["start"] >= state["at"], named).otherwise("")
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.concat(state["out"], kept, mark).alias("out"),
        )

    replaced = F.aggregate(
        ordered,
        start,
        add,
        lambda state: F.concat(
            state["out"],
            F.substring(text, (state["at"] + 1).cast("int"), F.length(text)),
        ),
    )
    return F.when(F.size(spans) > 0, replaced).otherwise(text)
