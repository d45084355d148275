"""Personal data: base patterns, plus spans that labelers vote for under weak supervision.

DataFrame functions only. The base kinds are regular expressions; a span's place follows from the
lengths of the texts between the matches, so nothing is exploded. Wider candidates (any word with a
digit or ``@`` that no base span covers) get votes from regex, gazetteer and context labelers, each
1 (private), 0 (not) or -1 (abstains). The corpus is reduced to counts of vote and feature patterns, a
table whose size is bounded by the number of patterns; on these counts expectation-maximisation
estimates the labelers' reliabilities and the share of private candidates, and a logistic classifier
over votes and span features is trained on the resulting probabilities. It is applied back as one SQL
expression. All candidates of all texts feed the counts.

Kinds that the method adds: ``secret`` (keys, tokens, passwords) and ``id`` (numbers of persons or
accounts such as national or bank account numbers, phone numbers without a plus sign).

Defined results: null text counts as empty; texts without digits and ``@`` have no spans; repeated
rows give repeated results; an empty table gives an empty result. Patterns are written with
possessive loops, so that very long runs of digits or letters take linear time and no stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, written

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
#: Words that may be private without fitting a base pattern.
#: A written-out phone number (one that runs into other digits fits no base pattern), or a word.
_CALL = r"(?:\+[0-9]{1,3}[\x20-]?)?\([0-9]{2,4}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}(?![0-9])"
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{_CALL}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Characters before a candidate that the context labelers see.
CONTEXT = 40

# The gazetteer and the cue words of the context labelers.
SECRET_CUES = "token|password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?key|credential|bearer|auth"
ID_CUES = "ssn|social security|iban|account|passport|tax id|phone|tel|mobile|fax|call|licen[cs]e no|national id"
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|xox[bap]-|sk_live_|sk-|AIza|eyJ"

_KEY = rf"(?:{KEY_PREFIXES})[A-Za-z0-9_-]{{10,}}|(?<![0-9A-Za-z])(?=[0-9]*+[a-f])[0-9a-f]{{16,}}(?![0-9A-Za-z])"
_NUMBER = rf"^{_CALL}|(?<![0-9])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9])|(?<![A-Z0-9])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?![A-Z0-9])"
_ASSIGNED = rf"(?i)(?:{SECRET_CUES})\s*[=:]|^(?:{KEY_PREFIXES})"
_QUANTITY = r"(?i)^[^0-9A-Za-z]*[0-9.,:/%-]{1,11}(?:st|nd|rd|th|am|pm|kg|km|cm|mm|m|s|h|gb|mb|usd|eur)?[^0-9A-Za-z]*$"
_CUED = rf"(?i)(?:^|[^a-z])(?:{SECRET_CUES}|{ID_CUES})[^a-z]{{0,6}}$"

#: (name, vote 1 where, vote 0 where), functions of the candidate t, the text c before it and its number of digits.
LABELERS = (
    ("regex_key", lambda t, c, d: t.rlike(_KEY), lambda t, c, d: F.length(t) < 8),
    ("regex_id", lambda t, c, d: t.rlike(_NUMBER), lambda t, c, d: t.rlike("^[0-9]{1,4}[^0-9A-Za-z]*$")),
    ("gazetteer", lambda t, c, d: t.rlike(_ASSIGNED), lambda t, c, d: t.rlike(_QUANTITY)),
    ("context", lambda t, c, d: c.rlike(_CUED), lambda t, c, d: c.rlike(r"[a-z][.,]?\x20$") & t.rlike("^[^0-9]*[0-9]{1,4}[^0-9]*$")),
    # A long number that fits no base pattern (a card number that fails its check, say) is most likely just a number.
    ("shape", lambda t, c, d: (d >= 6) & t.rlike("[A-Za-z(-]") & (F.length(t) >= 12), lambda t, c, d: (d < 4) | t.rlike("^[^0-9A-Za-z]*[0-9]+[^0-9A-Za-z]*$")),
)
#: Features of the final classifier besides the votes; each 0 or 1.
FEATURES = (
    ("long", lambda t, c, d: F.length(t) >= 16),
    ("mixed", lambda t, c, d: t.rlike("[A-Za-z]") & (d >= 4)),
    ("quoted", lambda t, c, d: t.rlike("[=\"']")),
    ("at", lambda t, c, d: t.contains("@")),
)
ROUNDS = 60


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    doubled = F.transform(
        chars, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fits(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(m))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _fitting(kind: str):
    return lambda x: _fits(kind, x["m"])


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


_SPANS = "array<struct<s:int,e:int,m:string>>"


def running(d: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks of about the root of its size: n ** 1.5 steps, not n ** 2."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blockwise(b: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / b).cast("int")), lambda k: total(F.slice(d, k * b + 1, b)))
        heads = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        block = lambda i: F.floor(i / b).cast("int")
        return let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda i: F.get(h, block(i)) + total(F.slice(d, block(i) * b + 1, i % b + 1))))

    return let(F.ceil(F.sqrt(F.size(d))).cast("int"), blockwise)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: code point places (end exclusive) and texts of the non-overlapping matches, leftmost first.

    Match i starts after the first i + 1 texts between matches and the first i matches.
    """
    none = F.array().cast(_SPANS)

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(gaps, lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)))
        starts = let(steps, running)
        placed = let(starts, lambda p: F.transform(found, lambda m, i: F.struct(F.get(p, i).alias("s"), (F.get(p, i) + F.length(m)).alias("e"), m.alias("m"))))
        return F.when(F.size(found) == 0, none).otherwise(placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``, the spans of the base kinds, and ``_wide``, the wider matches."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_body", F.when(body.rlike("[0-9@]"), body).otherwise(F.lit("")))
    none = F.array().cast(_SPANS)
    where = lambda spans: F.when(F.col("_body") == "", none).otherwise(spans)
    docs = docs.withColumns({f"_{k}": where(F.filter(matches(F.col("_body"), p), _fitting(k))) for k, p in BASE} | {"_wide": where(matches(F.col("_body"), CANDIDATE))})
    named = [F.transform(f"_{k}", _named(k)) for k, _ in BASE]
    return docs.withColumn("_base", F.concat(*named)).drop(*[f"_{k}" for k, _ in BASE])


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_candidates``: array<struct<s, e, t, c>> of candidates that no base span touches."""

    # What lambdas use of the row is bound first: a column that is read inside a lambda may be put there by the
    # optimizer as its whole expression, and be computed again for each element.
    def placed(base: Column, body: Column) -> Column:
        free = F.filter("_wide", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        before = lambda x: F.substring(body, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        return F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("t"), before(x).alias("c")))

    found = let(F.col("_base"), lambda base: let(F.col("_body"), lambda body: placed(base, body)))
    none = F.array().cast("array<struct<s:int,e:int,t:string,c:string>>")
    return docs.withColumn("_candidates", F.when(F.size("_wide") > 0, found).otherwise(none))


def voted(rows: DataFrame) -> DataFrame:
    """The labelers' votes and the features of rows with columns t and c."""
    t, c = F.col("t"), F.col("c")
    d = F.length(_digits(t))
    votes = [F.when(yes(t, c, d), 1).when(no(t, c, d), 0).otherwise(-1).alias(n) for n, yes, no in LABELERS]
    return rows.select(*votes, *[F.when(f(t, c, d), 1).otherwise(0).alias(n) for n, f in FEATURES])


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over (votes, count): (share of private, (right on private, right on others) by labeler, probability by pattern)."""
    k = len(patterns[0][0]) if patterns else 0
    share, right = 0.2, [(0.8, 0.8)] * k
    of = [0.0] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            a, b = math.log(share), math.log(1 - share)
            for v, (p, q) in zip(votes, right, strict=True):
                if v >= 0:
                    a += math.log(p if v else 1 - p)
                    b += math.log(1 - q if v else q)
            of[i] = 1 / (1 + math.exp(min(700.0, max(-700.0, b - a))))
        total = sum(n for _, n in patterns)
        # A Beta prior keeps every labeler better than chance, so that the classes can't swap.
        share = (sum(z * n for z, (_, n) in zip(of, patterns, strict=True)) + 2) / (total + 10)
        new = []
        for j in range(k):
            yes = [(z * n, v[j]) for z, (v, n) in zip(of, patterns, strict=True) if v[j] >= 0]
            no = [((1 - z) * n, v[j]) for z, (v, n) in zip(of, patterns, strict=True) if v[j] >= 0]
            p = (sum(w for w, v in yes if v) + 8) / (sum(w for w, _ in yes) + 10)
            q = (sum(w for w, v in no if not v) + 8) / (sum(w for w, _ in no) + 10)
            new.append((min(0.99, max(0.55, p)), min(0.99, max(0.55, q))))
        right = new
    return share, right, of


def classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], float, int]], rounds: int = 400) -> tuple[float, list[float]]:
    """Logistic regression on (votes, features, probability, count): (intercept, weights). A vote enters as +1, -1 or 0."""
    if not rows:
        return -1.0, []
    xs = [[(0 if v < 0 else 2 * v - 1) for v in votes] + [f for f in features] for votes, features, _, _ in rows]
    # Counts enter by their square root: frequent patterns must not drown rare kinds.
    ws = [math.sqrt(n) for *_, n in rows]
    total = sum(ws)
    b, w = 0.0, [0.0] * len(xs[0])
    for _ in range(rounds):
        gb, gw = 0.0, [1e-3 * x for x in w]
        for x, (_, _, z, _), n in zip(xs, rows, ws, strict=True):
            s = b + sum(p * q for p, q in zip(w, x, strict=True))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - z) * n / total
            gb += d
            for i, v in enumerate(x):
                gw[i] += d * v
        b -= 2.0 * gb
        w = [p - 2.0 * g for p, g in zip(w, gw, strict=True)]
    return b, w


def train(voted_rows: DataFrame) -> tuple[float, list[float]]:
    """The final classifier, from counts of patterns: at most 3**labelers * 2**features rows come to the driver."""
    names, extra = [n for n, *_ in LABELERS], [n for n, _ in FEATURES]
    counts = voted_rows.groupBy(*names, *extra).count().collect()
    votes: dict[tuple[int, ...], int] = {}
    for r in counts:
        key = tuple(r[n] for n in names)
        votes[key] = votes.get(key, 0) + r["count"]
    patterns = sorted(votes.items())
    _, _, of = reliabilities(patterns) if patterns else (0, [], [])
    belief = {v: z for (v, _), z in zip(patterns, of, strict=True)}
    rows = [(tuple(r[n] for n in names), tuple(r[n] for n in extra), belief[tuple(r[n] for n in names)], r["count"]) for r in counts]
    return classifier(sorted(rows))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``spans``: array<struct<k, s, e>>, base kinds first in their order, then the method's, each by place."""
    rows = candidates(base_spans(docs, text))
    # Only votes and features are written: what may be a secret stays in its text.
    seen = rows.where(F.size("_candidates") > 0).select(F.explode("_candidates").alias("x")).select("x.t", "x.c")
    votes = written(voted(seen), "pii-votes")
    intercept, weights = train(votes)
    discard(votes)

    def private(x: Column) -> Column:
        t, c = x["t"], x["c"]
        d = F.length(_digits(t))
        score, some = F.lit(intercept), F.lit(False)
        for (_, yes, no), w in zip(LABELERS, weights, strict=False):
            score = score + F.when(yes(t, c, d), F.lit(w)).when(no(t, c, d), F.lit(-w)).otherwise(F.lit(0.0))
            some = some | yes(t, c, d)
        for (_, f), w in zip(FEATURES, weights[len(LABELERS) :], strict=False):
            score = score + F.when(f(t, c, d), F.lit(w)).otherwise(F.lit(0.0))
        return some & (score > 0)

    secret = lambda x: x["t"].rlike(_KEY) | x["t"].rlike(_ASSIGNED) | x["c"].rlike(rf"(?i)(?:{SECRET_CUES})[^a-z]{{0,6}}$")
    name = lambda x: F.when(secret(x), "secret").otherwise("id")
    kinds = "array<struct<k:string,s:int,e:int>>"
    more = F.transform(F.filter("_candidates", private), lambda x: F.struct(name(x).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    rows = rows.withColumn("_more", F.when(F.size("_candidates") > 0, more).otherwise(F.array().cast(kinds)))
    of = lambda k: F.filter("_more", lambda x: x["k"] == k)
    rows = rows.withColumn("spans", F.concat("_base", of("secret"), of("id")))
    return rows.drop("_wide", "_candidates", "_more", "_body")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one's kind stays."""
    return F.when(F.size(spans) > 0, let(text, lambda t: _masked(t, spans))).otherwise(text)


def _masked(text: Column, spans: Column) -> Column:
    by_place = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def step(a: Column, x: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))), F.when(x["s"] >= a["at"], F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(F.lit("")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), fresh.alias("out"))

    return F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with private spans masked in ``text``; other columns as they are, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"))
    rows = find(packed).select(F.col("_row").withField(text, masked(F.col("text"), F.col("spans"))).alias("_row"))
    return rows.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[n(k) for k, _ in BASE], F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
