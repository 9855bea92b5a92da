"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities, a classifier decides.

Only DataFrame functions touch the rows. Candidates come from regular expressions: the base kinds email, ip, card and
phone, which always stay, and further kinds (ssn, iban, tel, mail_words), which the final classifier must accept.
Positions are code points: the lengths of what lies between matches (split) and of the matches (regexp_extract_all)
add up to them. The labelers are the strict shape, a gazetteer, the words around, and the neighbouring characters;
each votes for (1), against (-1) or not (0). Votes are counted by pattern, of which there are at most 8 x 81, and EM on those counts
estimates each labeler's reliability for either class, by kind. A logistic span classifier over kind, votes and span length is
then fitted to the EM posteriors of the same counts, and applied as an expression.

All work on a text is linear in its spans but for a factor of CHUNK, see _before. Expressions are written without backtracking (possessive), which gives the same matches in linear time; a match may
begin only where the last ended or at the start of a run of its characters, as a leftmost match does.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stash

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (expression, cheap test of the text that any match passes)
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
MORE = {
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[0-9]"),
    "tel": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "[0-9]"),
    "mail_words": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]++(?![A-Za-z0-9])", "[\\[(]"),
}
KINDS = [*BASE, *MORE]
#: Shapes that the strict labeler wants.
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?![^@]*\.\.)[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,10}$",
    "ip": r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$",
    "card": r"^([0-9]{4}[ -]?){3}[0-9]{1,4}([ -]?[0-9]{1,3})?$|^3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .(-]*[0-9][0-9 ().-]*$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4})++$",
    "tel": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$",
    "mail_words": r"^[A-Za-z].*$",
}
#: Gazetteers, as expressions on the span: top-level domains, public first octets, issuer prefixes, country codes.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|test|example)$",
    "ip": r"^(?!0|127\.|22[4-9]|2[3-5][0-9])[0-9]",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^[0-8]",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "tel": r"^\(?[2-9][0-9]{2}",
    "mail_words": r"(com|org|net|edu|de|fr|es|uk)$",
}
#: Words before a span that speak for it, and words that speak against any.
CONTEXT = {
    "email": r"mail|contact|write|reach|address|kontakt|courriel|correo",
    "ip": r"\bip\b|host|server|address|login|from|client",
    "card": r"card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|contact|anruf|llam",
    "ssn": r"ssn|social|security",
    "iban": r"iban|account|konto|compte|cuenta|bank",
    "tel": r"phone|tel|call|mobile|fax|contact",
    "mail_words": r"mail|contact|write|reach",
}
AGAINST = r"version|release|build|isbn|order no|invoice|serial|page"
LABELERS = ["v_shape", "v_gazetteer", "v_context", "v_edges"]


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn test."""
    back = F.reverse(F.split(digits, ""))

    def worth(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


#: Code points before a span in which the labeler of words looks.
CONTEXT_CHARS = 40
CHUNK = 64
_SPAN = "struct<start:int,ord:int,end:int,v_shape:int,v_gazetteer:int,v_context:int,v_edges:int,size:int>"


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, merge) -> Column:
    """For each value, all values before it merged with zero. Chunks of CHUNK values are merged first, so n values take CHUNK n + (n / CHUNK)**2 steps."""

    def with_chunks(chunks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            starts = F.transform(sums, lambda x, i: F.aggregate(F.slice(sums, F.lit(1), i), zero, merge))
            inner = lambda c, s: F.transform(c, lambda x, j: F.aggregate(F.slice(c, F.lit(1), j), s, merge))
            return F.flatten(F.zip_with(chunks, starts, inner))

        return _let(F.transform(chunks, lambda c: F.aggregate(c, zero, merge)), with_sums)

    def given(values: Column) -> Column:
        count = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(values) > 0, _let(chunks, with_chunks)).otherwise(values)

    return _let(values, given)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start, ord, end, votes..., size>> of one kind."""
    expression, test = (BASE | MORE)[kind]
    none = F.array().cast(f"array<{_SPAN}>")

    def row(x: Column) -> Column:
        m = x["m"]
        before = F.lower(F.substring(x["before"], -CONTEXT_CHARS, CONTEXT_CHARS))
        edge = F.substring(x["before"], -1, 1).rlike(r"[\p{L}\p{N}_]") | F.substring(x["after"], 1, 1).rlike(r"[\p{L}\p{N}_]")
        vote = lambda test: F.when(test, 1).otherwise(-1)
        return F.struct(
            x["at"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (x["at"] + F.length(m)).alias("end"),
            vote(m.rlike(SHAPE[kind])).alias("v_shape"), vote(m.rlike(GAZETTEER[kind])).alias("v_gazetteer"),
            F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0).alias("v_context"),
            F.when(edge, -1).otherwise(1).alias("v_edges"), F.floor(F.log2(F.length(m))).cast("int").alias("size"),
        )

    def located(matches: Column, gaps: Column) -> Column:
        """Starts: what lies before a match is the gaps and matches before it, and its own gap."""
        own = F.slice(gaps, F.lit(1), F.size(matches))
        sizes = F.zip_with(matches, own, lambda m, g: F.length(m) + F.length(g))
        starts = F.zip_with(_before(sizes, F.lit(0), lambda a, x: a + x), own, lambda s, g: s + F.length(g))
        rows = F.arrays_zip(starts.alias("at"), matches.alias("m"), own.alias("before"), F.slice(gaps, F.lit(2), F.size(matches)).alias("after"))
        return F.transform(F.filter(rows, lambda x: _holds(kind, x["m"])), row)

    def found(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, _let(F.split(text, expression, -1), lambda gaps: located(matches, gaps))).otherwise(none)

    possible = F.contains(text, F.lit(test)) if len(test) == 1 else text.rlike(test)
    return F.when(possible, _let(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), found)).otherwise(none)


def _apart(spans: Column) -> Column:
    """Of spans by start, those further ones that overlap no base span."""
    is_base = lambda s: s["ord"] < len(BASE)
    low, high = F.lit(-1), F.lit(2**31 - 1)
    ends = F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(low))
    starts = F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(high)))
    # The base span before that ends last, and the next one after.
    reach = _before(ends, low, lambda a, x: F.greatest(a, x))
    ahead = F.reverse(_before(starts, high, lambda a, x: F.least(a, x)))
    rows = F.arrays_zip(spans.alias("s"), reach.alias("r"), ahead.alias("n"))
    kept = F.filter(rows, lambda x: ~is_base(x["s"]) & (x["r"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"]))
    return F.transform(kept, lambda x: x["s"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): all candidate spans of each row, by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", F.array_sort(F.concat(*[_spans(F.col("t"), k) for k in KINDS])).alias("found"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 100) -> tuple[dict, dict]:
    """EM over (kind, votes, size, n): prior of the positive class by kind, and P(vote | class) by labeler.

    Labelers are taken as independent given the class; counts are smoothed by one. The start, posteriors of 0.9 and 0.1 by
    the majority of votes, fixes which class is which.
    """
    posterior = {v: 0.9 if sum(v) > 0 else 0.1 for _, v, _, _ in counts}
    post = {(k, v): posterior[v] for k, v, _, _ in counts}
    prior: dict[int, float] = {}
    given: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        mass: dict = {}
        for k, v, _, n in counts:
            for c, p in ((1, post[k, v]), (0, 1 - post[k, v])):
                mass["k", k, c] = mass.get(("k", k, c), 0) + n * p
                for i, x in enumerate(v):
                    mass[i, c, x] = mass.get((i, c, x), 0) + n * p
        prior = {k: (mass["k", k, 1] + 1) / (mass["k", k, 1] + mass["k", k, 0] + 2) for k, _, _, _ in counts}
        for i in range(len(LABELERS)):
            for c in (0, 1):
                total = sum(mass.get((i, c, x), 0) + 1 for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    given[i, c, x] = (mass.get((i, c, x), 0) + 1) / total
        change = 0.0
        for k, v in post:
            a = math.log(prior[k]) + sum(math.log(given[i, 1, x]) for i, x in enumerate(v))
            b = math.log(1 - prior[k]) + sum(math.log(given[i, 0, x]) for i, x in enumerate(v))
            new = 1 / (1 + math.exp(max(-700, min(700, b - a))))
            change = max(change, abs(new - post[k, v]))
            post[k, v] = new
        if change < 1e-6:
            break
    return post, {"prior": prior, "given": given}


def span_classifier(counts: list[tuple[int, tuple[int, ...], int, int]], post: dict, steps: int = 300, rate: float = 0.5) -> dict[tuple, float]:
    """Logistic regression of the posteriors on kind, votes and size class, by gradient descent on the counts."""
    features = {(k, v, s): [("kind", k), ("size", s), *(("vote", i, x) for i, x in enumerate(v))] for k, v, s, _ in counts}
    weight: dict[tuple, float] = {f: 0.0 for fs in features.values() for f in fs}
    total = sum(n for *_, n in counts) or 1
    for _ in range(steps):
        slope = dict.fromkeys(weight, 0.0)
        for k, v, s, n in counts:
            z = sum(weight[f] for f in features[k, v, s])
            error = post[k, v] - 1 / (1 + math.exp(-max(-50, min(50, z))))
            for f in features[k, v, s]:
                slope[f] += error * n / total
        for f, g in slope.items():
            weight[f] += rate * (g - 1e-4 * weight[f])
    return weight


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row of docs.

    Defined cases: null text counts as empty; rows without spans have zero counts, the hash of the empty string and an
    empty spans string; repeated rows stay; spans of different kinds may overlap, but a further span that overlaps a
    base span is left out; an empty table gives an empty result; other columns are ignored.
    """
    found = stash(candidates(docs, id_col, text_col), "spans")
    grouped = found.select(F.explode("found").alias("s")).groupBy("s.ord", *[f"s.{x}" for x in LABELERS], "s.size").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["ord"], tuple(r[x] for x in LABELERS), r["size"], r["n"]) for r in grouped.collect())  # at most 8 x 81 x sizes
    post, _ = reliabilities(counts)
    weight = span_classifier(counts, post)

    def score(s: Column) -> Column:
        parts = [(s["ord"], "kind", None), (s["size"], "size", None), *((s[x], "vote", i) for i, x in enumerate(LABELERS))]
        terms = []
        for col, what, i in parts:
            own = {(f[-1]): w for f, w in weight.items() if f[0] == what and (i is None or f[1] == i)}
            terms.append(reduce(lambda e, kv: F.when(col == kv[0], kv[1]).otherwise(e), own.items(), F.lit(0.0)))
        return reduce(lambda a, b: a + b, terms)

    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    bar = math.log(accept / (1 - accept))
    further = F.exists("found", lambda s: s["ord"] >= len(BASE))
    more = F.when(further, F.filter(_let(F.col("found"), _apart), lambda s: score(s) >= bar)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    name = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("found", lambda s: s["ord"] == KINDS.index(k))).cast("bigint")
    every = F.when(F.size(more) > 0, F.array_sort(F.concat(base, more))).otherwise(base)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.size(every).cast("bigint").alias("n_spans"),
    )
