"""Personal data by weak supervision, in DataFrame functions only.

Candidates of each kind come from the kind's base pattern and from a broader one. Labelers vote on each (yes 1, no -1, abstain 0): the base rule,
a shape rule, a gazetteer, words of the context before it, and the characters beside it. Expectation-maximisation over the
counts of vote patterns (a table bounded by 3^5 patterns a kind) estimates every labeler's reliability per kind and
the probability that a candidate of a pattern is personal data; those soft labels train the final span classifier, a
naive Bayes model over the votes, the length and the character before. Broader candidates that it accepts are added to
the base spans, which always stay. All steps are column expressions and aggregations; the driver sees only parameter tables of
bounded size.

Base patterns are written so that the regex engine never goes back over a run (possessive, anchored at a run's begin or the last match's end);
they match exactly what the plain ones in PLAIN do. Offsets are code points, summed from the pieces between matches.

Cases: a null or empty text has no spans; rows that share an id are each answered, and repeated rows count as often in the
votes; very long texts are searched whole, in time that grows about as their length (runs are matched possessively, offsets are
sums over blocks of matches, and overlaps are told from sorted spans); a candidate whose score is
exactly 0 isn't added; empty tables give no rows and no labelers to train; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

KINDS = ("email", "ip", "card", "phone")
#: What the base patterns mean, in the plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run of fewer than 13 digits fails the card's rule anyway, so the pattern needn't match it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9+()./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Texts without a match of it hold no candidate of the kind.
HINT = {"email": r"@|[\[({] ?(?:at|AT)", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"(?:[0-9][\x20-]?){3}[0-9]", "phone": r"\+[0-9]|[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers and words of the context before a span, as fixed values.
TOP_DOMAINS = "com org net edu gov io info biz de fr es it uk us eu ca au ch at nl".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98".split()
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|addr|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
}
VOTES = ("rule", "shape", "gazetteer", "context", "beside")
FEATURES = (*VOTES, "size", "before")
#: EM ends when no parameter moves by more.
SETTLED = 1e-4

SPAN = "struct<kind:string,start:int,end:int>"
FOUND = "struct<kind:string,start:int,end:int,base:boolean,f:array<int>>"
#: Rows of a block of _scan.
BLOCK = 64


def _let(value: Column, of) -> Column:
    """of(value) with value computed once."""
    return F.transform(F.array(value), of)[0]


def _scan(rows: Column, start: Column, combine, measure: str, row) -> Column:
    """row(state, x) for each x of an array, state being start combined with the measures of all that stand before x. Spark copies the state of an
    aggregate at each step, so nothing gathers rows in one: blocks are summed up, and each row sums up its block's part and the blocks before."""

    def upto(values: Column, n: Column, first: Column) -> Column:
        return F.aggregate(F.slice(values, F.lit(1), n), first, combine)

    def of_block(k: Column, before: Column) -> Column:
        return _let(F.transform(k, lambda x: x[measure]), lambda ms: F.transform(k, lambda x, i: row(upto(ms, i, before), x)))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda k: F.aggregate(F.transform(k, lambda x: x[measure]), start, combine))
        return _let(sums, lambda t: F.flatten(F.transform(blocks, lambda k, b: _let(upto(t, b, start), lambda before: of_block(k, before)))))

    def of_rows(all_rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(all_rows) / BLOCK).cast("int") - 1)), lambda b: F.slice(all_rows, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, of_blocks)

    return _let(rows, of_rows)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, left, right>>: matches with the 24 characters before and the one after."""
    m, s = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    rows = F.arrays_zip(m.alias("m"), F.slice(s, 1, F.size(m)).alias("l"), F.slice(s, 2, F.size(m)).alias("r"))

    def measured(x: Column) -> Column:
        free, own = F.length(x["l"]), F.length(x["m"])
        return F.struct(x["m"].alias("m"), F.right(x["l"], F.lit(24)).alias("left"), F.left(x["r"], F.lit(1)).alias("right"), free.alias("free"), own.alias("own"), (free + own).alias("n"))

    def placed(pos: Column, x: Column) -> Column:
        return _let(pos + x["free"], lambda at: F.struct(at.alias("start"), (at + x["own"]).alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))

    return _scan(F.transform(rows, measured), F.lit(0), lambda a, n: a + n, "n", placed)


def _clear(strict: Column, broad: Column) -> Column:
    """The broad candidates that overlap no strict one of their kind. Strict ones are disjoint, so of those that begin no later only the last can
    overlap, and of the others only the first: a pass upwards and one downwards over the sorted spans tell."""
    never = (1 << 31) - 1

    def item(c: Column, base: bool) -> Column:
        last, first = (c["end"], c["start"]) if base else (F.lit(-1), F.lit(never))
        return F.struct(c["start"].alias("start"), F.lit(0 if base else 1).alias("turn"), c["end"].alias("end"), last.alias("last"), first.alias("first"), F.lit(True).alias("free"), c.alias("c"))

    def flagged(x: Column, ok: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["turn"].alias("turn"), x["end"].alias("end"), x["last"].alias("last"), x["first"].alias("first"), (x["free"] & ok).alias("free"), x["c"].alias("c"))

    spans = F.array_sort(F.concat(F.transform(strict, lambda c: item(c, True)), F.transform(broad, lambda c: item(c, False))))
    up = _scan(spans, F.lit(-1), lambda a, n: F.greatest(a, n), "last", lambda end, x: flagged(x, end <= x["start"]))
    down = _scan(F.reverse(up), F.lit(never), lambda a, n: F.least(a, n), "first", lambda start, x: flagged(x, start >= x["end"]))
    return F.transform(F.filter(F.reverse(down), lambda x: (x["turn"] == 1) & x["free"]), lambda x: x["c"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), term)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def rule(kind: str, m: Column) -> Column:
    """What a match of the base pattern must pass besides."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$") & ~m.rlike(r"\.$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, base: bool):
    """Column function: a match -> a candidate with its features."""

    def of(x: Column) -> Column:
        m, d = x["m"], _digits(x["m"])
        if kind == "email":
            end = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
            shape, listed = _vote(end.rlike(r"^[a-z]{2,}$"), F.lit(True)), _vote(end.isin(TOP_DOMAINS), ~end.rlike("[a-z]"))
        elif kind == "ip":
            shape = _vote(~m.rlike(r"(?:^|\.)0[0-9]"), F.lit(True))
            listed = _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), m.rlike(r"^(?:0|255)\."))
        elif kind == "card":
            shape, listed = _vote(F.length(d).isin(15, 16), F.lit(True)), _vote(d.rlike(CARD_PREFIXES), F.lit(True))
        else:
            shape = _vote(F.length(d).between(10, 13), F.lit(True))
            listed = _vote(F.when(m.startswith("+"), F.substring(d, 1, 1).isin(COUNTRY_CODES) | F.substring(d, 1, 2).isin(COUNTRY_CODES)).otherwise(F.lit(False)), d.startswith("000"))
        before = F.right(x["left"], F.lit(1))
        joined = before.rlike(r'[\p{L}0-9=_"#/]') | x["right"].rlike(r'[\p{L}0-9=_"#/]')
        votes = [F.lit(1 if base else 0), shape, listed, _vote(x["left"].rlike(CONTEXT[kind]), F.lit(False)), _vote(~joined, joined)]
        size = F.least(F.lit(7), F.floor(F.length(m) / 4))
        left = F.when(before == "", 0).when(before.rlike(r"\s"), 1).otherwise(2)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.array(*[v.cast("int") for v in (*votes, size, left)]).alias("f"))

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, base, f>>): one row per document row, in the order of kinds and starts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = []
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,f:array<int>>>")
    for k in KINDS:
        strict = F.transform(F.filter(_matches(F.col("text"), BASE[k]), lambda x: rule(k, x["m"])), _candidate(k, True))  # noqa: B023
        broad = F.transform(_matches(F.col("text"), BROAD[k]), _candidate(k, False))
        both = lambda p, f: F.when(F.col("text").rlike(p), f).otherwise(empty)
        kinds.append(F.when(F.col("text").rlike(HINT[k]), F.concat(both(BASE[k], strict), both(BROAD[k], broad))).otherwise(empty))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.concat(*kinds).alias("found"))


def _by_kind(table: dict[str, list[float]]) -> Column:
    """A literal map from the kind to its parameters."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])


def _log_odds(table: dict[str, list[float]]) -> dict[str, list[float]]:
    """Per kind: the prior's log odds, then for each labeler those of a yes, a no and an abstention."""
    out = {}
    for k, p in table.items():
        out[k] = [math.log(p[0] / (1 - p[0]))]
        for j in range(len(VOTES)):
            y1, n1, y0, n0 = p[1 + 4 * j : 5 + 4 * j]
            out[k] += [math.log(y1 / y0), math.log(n1 / n0), math.log(max(1e-6, 1 - y1 - n1) / max(1e-6, 1 - y0 - n0))]
    return out


def _posterior(p: Column) -> Column:
    """P(personal) of a pattern f, from the log odds of its kind."""
    f = F.col("f")
    votes = F.transform(F.sequence(F.lit(0), F.lit(len(VOTES) - 1)), lambda j: F.get(p, 1 + 3 * j + F.when(F.get(f, j) == 1, 0).when(F.get(f, j) == -1, 1).otherwise(2)))
    odds = F.aggregate(votes, F.get(p, F.lit(0)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def reliabilities(patterns: DataFrame, settled: float = SETTLED) -> tuple[Column, dict[str, list[float]]]:
    """EM over patterns(kind, f, n), until its parameters settle: P(personal) of a pattern as a column, and each kind's parameters: the prior,
    then for each labeler P(yes | personal), P(no | personal), P(yes | not), P(no | not)."""
    f = F.col("f")
    patterns = cut(patterns.groupBy("kind", F.slice("f", 1, len(VOTES)).alias("f")).agg(F.sum("n").alias("n")).coalesce(1), "pii-votes")  # at most 3^5 a kind
    q = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [f[j] for j in range(len(VOTES))]).cast("double")))  # begin with the vote's balance
    table: dict[str, list[float]] = {}
    while True:
        w, v = F.col("w"), F.col("v")
        sums = [F.sum(w).alias("w"), F.sum(v).alias("v")]
        for j in range(len(VOTES)):
            for side, s in (("w", w), ("v", v)):
                for vote in (1, -1):
                    sums.append(F.sum(F.when(f[j] == vote, s).otherwise(0.0)).alias(f"{side}{j}{vote}"))
        soft = patterns.withColumn("q", q).select("kind", "f", (F.col("n") * F.col("q")).alias("w"), (F.col("n") * (1 - F.col("q"))).alias("v"))
        rows = soft.groupBy("kind").agg(*sums).collect()  # a row a kind
        if not rows:
            return F.lit(0.0), {}
        before, table = table, {r["kind"]: [(r["w"] + 1) / (r["w"] + r["v"] + 2), *[(r[f"{s}{j}{vote}"] + 0.5) / (r[s] + 1.5) for j in range(len(VOTES)) for s in ("w", "v") for vote in (1, -1)]] for r in rows}
        q = F.transform(F.array(F.element_at(_by_kind(_log_odds(table)), F.col("kind"))), _posterior)[0]
        if before and max(abs(x - y) for k in table for x, y in zip(before[k], table[k], strict=True)) <= settled:
            return q, table


def classifier(patterns: DataFrame, q: Column) -> dict[str, float]:
    """Naive Bayes over the soft labels: 'kind' -> prior log odds, 'kind|feature|value' -> weight; at most 30 entries a kind."""
    soft = patterns.withColumn("q", q).select("kind", "n", "q", F.posexplode("f").alias("j", "v"))
    rows = soft.groupBy("kind", "j", "v").agg(F.sum(F.col("n") * F.col("q")).alias("w"), F.sum(F.col("n") * (1 - F.col("q"))).alias("o")).collect()
    out: dict[str, float] = {}
    for k in {r["kind"] for r in rows}:
        w, o = (sum(r[c] for r in rows if r["kind"] == k and r["j"] == 0) for c in "wo")
        out[k] = math.log((w + 1) / (o + 1))
        for r in rows:
            if r["kind"] == k and r["j"] != 0:  # the base rule's own vote would only tell where a candidate came from
                out[f"{k}|{r['j']}|{r['v']}"] = math.log((r["w"] + 0.5) / (w + 1)) - math.log((r["o"] + 0.5) / (o + 1))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base array<SPAN>, spans array<SPAN>): one row per document row."""
    found = cut(candidates(docs), "pii-candidates")
    patterns = cut(found.select(F.explode("found").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.f").alias("f")).agg(F.count("*").alias("n")), "pii-patterns")
    q, table = reliabilities(patterns)
    weights = classifier(patterns, q) if table else {}
    w = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def score(c: Column) -> Column:
        get = lambda key: F.coalesce(F.try_element_at(w, key), F.lit(0.0))
        each = F.transform(F.sequence(F.lit(1), F.lit(len(FEATURES) - 1)), lambda j: get(F.concat_ws("|", c["kind"], j.cast("string"), F.get(c["f"], j).cast("string"))))
        return F.aggregate(each, get(c["kind"]), lambda a, x: a + x)

    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda c: F.struct(rank[c["kind"]].alias("r"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))), span)
    of = lambda a, k: F.filter(a, lambda c: c["kind"] == k)
    parts = found.select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), F.filter("found", lambda c: ~c["base"] & (score(c) > 0)).alias("accepted"))
    clear = F.concat(*[_clear(of("base", k), of("accepted", k)) for k in KINDS])
    added = F.when((F.size("accepted") == 0) | (F.size("base") == 0), F.col("accepted")).otherwise(clear)
    return parts.select("doc_id", "base", added.alias("added")).select("doc_id", F.transform("base", span).alias("base"), order(F.concat("base", "added")).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
