"""URL filter: host and path rules, and a weighted vocabulary found by an Aho-Corasick automaton.

A URL without a fitting rule is judged by its words: one strict term, or SOFT_DISTINCT different soft terms or more whose weights
add up to SOFT_WEIGHT, reject it. So two strong soft terms are enough, of weak ones it takes three to five. A term counts only
between boundaries, where the characters beside it are no ASCII letters or digits. The vocabulary is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_arrow

#: (verdict, host, path): a rule fits its host and all subdomains, where the path begins with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
STRICT = tuple("""porn porno pornos pornstar xxx hentai milf camgirl camgirls sexcam sexcams escort escorts bdsm fetish gangbang upskirt
warez keygen keygens phishing malware ransomware spyware botnet carding cvv2 fullz""".split())  # fmt: skip
#: Soft terms by weight.
SOFT = {t: w for w, terms in {
    12: "casino casinos betting sportsbet jackpot roulette slots viagra cialis tramadol nude nudes naked sexy clickbait adserver doubleclick payday",
    9: "poker bet bets bingo lottery lotto adult sex erotic dating hookup singles torrent torrents crack cracked serials popup popups popunder affiliate affiliates telemetry replica",
    6: "banner banners tracker tracking track clickid clk sponsored sponsor promo promos coupon coupons deal deals loan loans credit forex bitcoin crypto pills pharmacy weightloss",
    4: "ad ads click clicks pixel beacon utm ref cheap free win winner bonus offer offers buy redirect redir out goto",
}.items() for t in terms.split()}
SOFT_DISTINCT, SOFT_WEIGHT = 2, 18
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or where there is no `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_UPPER), path[:stop]


class Rules:
    """Longest rule that fits; looked up by the host's suffixes, so the number of rules doesn't count."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            name = ".".join(labels[i:])
            for prefix, verdict in self.by_host.get(name, ()):
                rule = name + prefix
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


class Vocabulary:
    def __init__(self, strict=STRICT, soft=SOFT):
        self.words = ahocorasick.Automaton()
        for term in soft:
            self.words.add_word(term, (term, False))
        for term in strict:
            self.words.add_word(term, (term, True))
        self.words.make_automaton()
        self.soft = soft

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms between boundaries."""
        low = url.translate(_UPPER)
        strict: set[str] = set()
        soft: set[str] = set()
        for end, (term, is_strict) in self.words.iter(low):
            start = end + 1 - len(term)
            if not (start and _inner(low[start - 1]) or end + 1 < len(low) and _inner(low[end + 1])):
                (strict if is_strict else soft).add(term)
        return strict, soft

    def rejects(self, strict: set[str], soft: set[str]) -> bool:
        return bool(strict) or len(soft) >= SOFT_DISTINCT and sum(map(self.soft.__getitem__, soft)) >= SOFT_WEIGHT


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft) of every row of pages.

    Defined cases: null and malformed URLs have empty host and path, fit no rule and are judged by their words (null has none);
    of rules of equal length the first wins; repeated rows stay; an empty table gives an empty result; other columns
    are ignored.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, words = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = table.find(host, path)
                hard, weak = words.hits(url or "")
                verdict = rule[1] if rule else "block" if words.rejects(hard, weak) else "allow"
                for col, x in zip(out, (host, path, rule and rule[0], verdict, len(hard), len(weak))):
                    col.append(x)
            names = ("host", "path", "rule", "verdict")
            yield {"page_id": batch.column(0), **{n: pa.array(c, pa.string()) for n, c in zip(names, out)}, "n_strict": pa.array(out[4], pa.int32()), "n_soft": pa.array(out[5], pa.int32())}

    kind = dict(pages.dtypes)[id_col]
    return map_arrow(pages, step, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int", [id_col, url_col])


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT) -> str:
    """The same in DuckDB SQL, over the table pages."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda t: f"CASE WHEN regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}')"
    return f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, url,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    {" + ".join(map(has, strict))} AS n_strict,
    {" + ".join(map(has, soft))} AS n_soft,
    {" + ".join(f"{w} * ({has(t)})" for t, w in soft.items())} AS soft_weight
  FROM rest
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2]}'" for r in ordered)} END AS rule,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in ordered)} END AS ruling
  FROM parts
)
SELECT page_id, host, path, rule,
  coalesce(ruling, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_DISTINCT} AND soft_weight >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft
FROM ruled"""
