"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how reliable each is, and a span classifier is trained on the resulting probabilities.

DataFrame operations only. E-mail, IP, card and phone spans follow fixed rules and always stand. All
other tokens that hold a digit are candidates for the kind ``secret`` (keys, passwords, account
numbers): a format labeler (regex), a gazetteer labeler (cue words before the token, harmless terms)
and a context labeler (signs around, make-up of the token) vote yes, no or abstain. Votes and
features take few values, so all candidates of a corpus are summed up by pattern - PATTERNS rows at
most - and both estimations run on those counts. Texts are read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.names import fresh
from inkframe.session import cut

KINDS = ("email", "ip", "card", "phone", "secret")
#: Java patterns of the contract's rules. A run is entered at its start or where the last match
#: ended, and possessive repeats never give back: the same matches, in linear time.
_MAIL = "A-Za-z0-9._%+-"
RULES = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{8,}+(?![.]?[A-Za-z0-9@])"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Fixed word lists of the gazetteer labeler.
CUES = "password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|account|iban|passport|ssn"
HARMLESS = "covid-19|utf-8|utf-16|sha256|sha-256|iso-8859-1|mp3|h264|x86_64|base64"
FORMATS = "AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[0-9]*[a-f])[0-9a-f]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
LABELERS = ("v_format", "v_gazetteer", "v_context")
FEATURES = ("f_long", "f_digits", "f_mixed", "f_quoted", "f_cue")
#: 3 votes of 3 values and 5 features of 2.
PATTERNS = 27 * 32
_ROUNDS = 200


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _may_match(kind: str, text: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def _matches(kind: str, text: Column) -> Column:
    """Array of (gap, m): the text before each match since the last one, and the match; then the rest with m null."""
    pattern = RULES.get(kind, CANDIDATE)
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return found


def votes(token: Column, before: Column) -> dict[str, Column]:
    """What each labeler says of a candidate (1 personal, 0 not, -1 nothing) and the classifier's features."""
    head = F.lower(before)
    cue = head.rlike(rf"(?:{CUES})\W{{0,4}}$")
    quoted = before.rlike(r"[=:\"']\s?[\"']?$")
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    size = F.length(token)
    mixed = token.rlike("[0-9][A-Za-z]+[0-9]")
    pick = lambda *cases: F.coalesce(*[F.when(c, F.lit(v)) for c, v in cases], F.lit(-1))
    return {
        "v_format": pick((token.rlike(f"^(?:{FORMATS})$"), 1), (token.rlike("^[a-z]+[-_/][0-9]{1,2}$|^[0-9-]+$"), 0)),
        "v_gazetteer": pick((cue, 1), (F.lower(token).rlike(f"^(?:{HARMLESS})$"), 0)),
        "v_context": pick((quoted & (size >= 8), 1), (mixed & (size >= 16), 1), (~quoted & ((size < 12) | token.rlike("^[0-9-]+$")), 0)),
        "f_long": (size >= 16).cast("int"), "f_digits": (digits * 4 >= size).cast("int"), "f_mixed": mixed.cast("int"),
        "f_quoted": quoted.cast("int"), "f_cue": cue.cast("int"),
    }


def expectation_maximisation(patterns: dict[tuple, int]) -> tuple[dict[tuple, float], list]:
    """Two-class model of conditionally independent labelers over vote patterns with counts:
    (probability of personal by pattern, [(P(1|yes), P(1|no)) of each labeler])."""
    n = len(LABELERS)
    belief = {v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)) for v in patterns}
    rates: list = []
    for _ in range(_ROUNDS):
        share = (1 + sum(c * belief[v] for v, c in patterns.items())) / (2 + sum(patterns.values()))
        rates = []
        for j in range(n):
            own = {v: c for v, c in patterns.items() if v[j] >= 0}
            of = lambda said, yes: sum(c * (belief[v] if yes else 1 - belief[v]) for v, c in own.items() if said is None or v[j] == said)  # noqa: E731, B023
            # priors: a labeler is right more often than wrong
            rates.append(((of(1, True) + 4) / (of(None, True) + 5), (of(1, False) + 1) / (of(None, False) + 5)))
        new = {}
        for v in patterns:
            odds = math.log(share / (1 - share))
            for (a, b), x in zip(rates, v, strict=True):
                odds += math.log(a / b) if x == 1 else math.log((1 - a) / (1 - b)) if x == 0 else 0
            new[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        moved = max((abs(new[v] - belief[v]) for v in new), default=0)
        belief = new
        if moved < 1e-9:
            break
    return belief, rates


def train(rows: list[tuple[tuple, float, int]], steps: int = 400) -> list[float]:
    """Logistic regression (bias first) on (features, probability, count) by gradient steps with a small ridge."""
    if not rows:
        return [-1.0] + [0.0] * (len(FEATURES) + len(LABELERS) * 2)
    width, total = len(rows[0][0]) + 1, sum(c for _, _, c in rows)
    w = [0.0] * width
    for _ in range(steps):
        grad = [0.001 * x for x in w]
        for x, p, c in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))
            d = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * c / total
            grad[0] += d
            for i, v in enumerate(x):
                if v:
                    grad[i + 1] += d * v
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _inputs(v: dict) -> list:
    """Features of the classifier: those of the span, and each labeler's yes and no."""
    return [v[f] for f in FEATURES] + [x for name in LABELERS for x in ((v[name] == 1), (v[name] == 0))]


def spans(docs: DataFrame) -> DataFrame:
    """One row per match of every kind, with position; documents without any have one row of null kind.

    Columns: __row, doc_id, kind (index in KINDS), start, end (code points), votes and features.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("__row", F.monotonically_increasing_id())
    arrays = []
    for k, kind in enumerate(KINDS):
        found = F.filter(_matches(kind, F.col("text")), lambda x: x["m"].isNotNull())
        held = F.transform(found, _entry(k))
        arrays.append(F.when(_may_match(kind, F.col("text")), held).otherwise(F.array().cast("array<struct<kind:int,gap:int,m:string,before:string>>")))
    rows = own.select("__row", "doc_id", F.posexplode_outer(F.concat(*arrays)).alias("pos", "s")).select("__row", "doc_id", "pos", "s.*")
    upto = Window.partitionBy("__row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    checks = F.coalesce(*[F.when(F.col("kind") == k, _valid(kind, F.col("m"))) for k, kind in enumerate(KINDS)], F.lit(False))
    rows = rows.withColumns({"end": end, "start": end - F.length("m")}).withColumn("kind", F.when(checks, F.col("kind")))
    # a candidate that meets a span of the rules is part of it
    ruled, order = F.col("kind") < KINDS.index("secret"), Window.partitionBy("__row").orderBy("start", "end")
    before = F.max(F.when(ruled, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(ruled, F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("__met", ~ruled & ((before > F.col("start")) | (after < F.col("end"))))
    kind = F.when(~F.coalesce("__met", F.lit(False)), F.col("kind"))
    return rows.select("__row", "doc_id", kind.alias("kind"), "start", "end", *[c.alias(n) for n, c in votes(F.col("m"), F.col("before")).items()])


def _entry(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["m"].alias("m"), F.right(x["gap"], F.lit(24)).alias("before"))


class SpanClassifier:
    """Reliabilities of the labelers and weights of the classifier, fitted on the candidates among spans()."""

    def __init__(self, found: DataFrame):
        own = found.where(F.col("kind") == KINDS.index("secret"))
        counts = own.groupBy(*LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # PATTERNS rows at most
        by_vote: dict[tuple, int] = {}
        for r in counts:
            key = tuple(r[x] for x in LABELERS)
            by_vote[key] = by_vote.get(key, 0) + r["n"]
        belief, self.reliability = expectation_maximisation(by_vote)
        self.weights = train([([float(x) for x in _inputs(r.asDict())], belief[tuple(r[x] for x in LABELERS)], r["n"]) for r in counts])

    def accepts(self, v: dict[str, Column]) -> Column:
        score = F.lit(self.weights[0])
        for w, x in zip(self.weights[1:], _inputs(v), strict=True):
            score = score + F.lit(w) * x.cast("double")
        return score >= 0


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data in every document, one row each.

    A null text counts as empty; documents without spans have the digest of an empty string. Repeated
    rows are rows of their own. An empty table gives no rows.
    """
    found = cut(spans(docs))
    model = SpanClassifier(found)
    secret = KINDS.index("secret")
    kept = (F.col("kind") != secret) | model.accepts({c: F.col(c) for c in (*LABELERS, *FEATURES)})
    place = F.struct("start", "kind", "end")
    named = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    out = found.groupBy("__row", "doc_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.collect_list(F.when(kept, place)).alias("all"),
        F.count_if((F.col("kind") == secret) & kept).alias("n_kept"),
    )
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(named(F.filter("all", lambda s: s["kind"] != secret)), 256).alias("base_sha256"),
        named(F.col("all")).alias("spans"), F.col("n_kept").alias("n_secret"),
    )


def _instead(kind: str, model: SpanClassifier):
    def replaced(x: Column) -> Column:
        good = model.accepts(votes(x["m"], F.right(x["gap"], F.lit(24)))) if kind == "secret" else _valid(kind, x["m"])
        return F.concat(x["gap"], F.when(x["m"].isNull(), F.lit("")).when(good, F.lit(f"[{kind.upper()}]")).otherwise(x["m"]))

    return replaced


def redact(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; n_chars follows, if there.

    One pass, kind by kind in the order of KINDS; rows without spans come back as they are.
    """
    columns, text = docs.columns, F.col("text").cast("string")
    for kind in KINDS:
        old, instead, name = text, _instead(kind, model), fresh(docs, f"text_{kind}")
        docs = docs.withColumn(name, F.when(_may_match(kind, old), F.array_join(F.transform(_matches(kind, old), instead), "")).otherwise(old))
        text = F.col(name)
    named = {"text": text}
    if "n_chars" in columns:
        named["n_chars"] = F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return docs.select(*[named[c].cast(docs.schema[c].dataType).alias(c) if c in named else F.col(c) for c in columns])
