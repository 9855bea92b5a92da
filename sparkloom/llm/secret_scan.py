"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

Base kinds are three patterns. Beyond them every long string in a sensitive context (a word like password, token or
credential in its line, the line before or the line after, a key in front of '=' included) is a candidate. Its novelty is the marginal
bytes a character that zstandard needs for it when it is primed with a dictionary of identifiers and with the text on both sides of the
candidate in those lines. The dictionary holds the most frequent words of all documents, after the fixed words of DICTIONARY, so
ordinary words and identifiers cost a few bytes each, random strings their entropy. The string is also measured in lower case, each
change of case costing a bit, as identifiers come in several cases. Candidates of NOVEL bytes a character or more are reported as
kind `novel`, letters alone included; those under LONG characters, for which zstandard can't tell much, need a digit and a
letter besides.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: '=' and ':' end a candidate, but for the padding of base64.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{8,}(?:={1,2}(?![A-Za-z0-9+/_=.~-]))?")
SENSITIVE = re.compile(r"(?i:passw|pwd|secret|token|api[_ -]?key|credential|bearer|authorization|private[_ -]?key|access[_ -]?key|signature)", re.ASCII)
_HINTS = ("passw", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature")
#: Code points on either side of a candidate, of its lines, that prime the compressor at most; what is sensitive is sought in whole lines.
CONTEXT = 1000
#: Bytes a character, set between identifiers, paths and prose on one side and random strings on the other (see the test).
NOVEL = 0.82
LONG = 16
#: Words of the documents in the dictionary.
WORDS = 2000
#: What identifiers and prose are made of; primes the compressor.
DICTIONARY = " ".join("""
action admin agent alert alias amount application array audit backup balance batch batch_size before branch bucket buffer builder button bytes cache callback cancel
channel class cluster column command commit component connection const content_type context controller cookie count counter create current cursor data database date
debug default delete deploy description device directory domain double driver email enable endpoint engine entry environment error event example exception execute expiry
export factory false field file filename filter final flag folder format from function gateway global group handler hash header height history host http https
identifier image import index info init input insert instance integer interface internal invalid item iterator job json label language last layout length level limit
line list loader local location lock logger login mapping master max_length member memory message metadata method metrics migration mode model module monitor name
network node null number object offset operation option order output owner package page parameter parser patch path payload payment pending permission placeholder
platform player policy pool port prefix primary process profile project property provider proxy public query queue random range read record recovery redirect
refresh region register release remote remove render replica report repository request reset resource response result retry return role root route runtime sample
schedule schema scope script search section secure select sender sequence serial server service session settings shared signature size snapshot socket source stack
start state static status storage stream string subject submit success suffix summary system table target task template temp test text thread threshold time
timeout timestamp title topic trace transaction transfer true type update upload url user username validate value variable vector verify version view void volume
warning width window worker write year zone public static final changeme your_password_here your_token_here default_value client_id client_secret user_id
access_key private_key secret_key api_key access_token refresh_token auth_token authorization bearer credential credentials secret token passwd password
""".split()).encode()  # fmt: skip


def identifier_dictionary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> bytes:
    """The most frequent words of letters over all documents, the rarest first, before DICTIONARY."""
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    top = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()
    return " ".join(r["w"] for r in reversed(top)).encode() + b" " + DICTIONARY


class Novelty:
    """Marginal compressed bytes a character of a string among its surroundings."""

    def __init__(self, dictionary: bytes = DICTIONARY):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def __call__(self, context: str, value: str) -> float:
        context = context.replace(value, " ")  # what it repeats is no surrounding
        bare = self._size(context)
        cost = self._size(context + value) - bare
        low = value.lower()
        if low != value:
            turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
            cost = min(cost, self._size(context + low) - bare + turns / 8)
        return max(0, cost) / max(1, len(value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base spans, by start, then kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, bar: float = NOVEL) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context that touch no base span."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    words = [(m.start(), m.end()) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts = [s for s, _ in words]
    heads, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        letters, digits = sum(map(str.isalpha, value)), sum(map(str.isdigit, value))
        if letters < 3 or len(value) < LONG and not digits or "@" in (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]):
            continue
        line = text.rfind("\n", 0, m.start())
        first = text.rfind("\n", 0, line) + 1 if line > 0 else 0
        last = text.find("\n", m.end())
        last = text.find("\n", last + 1) if last >= 0 else -1
        last = len(text) if last < 0 else last
        near = words[bisect.bisect_left(starts, first) : bisect.bisect_left(starts, last)]
        # A sensitive word within the candidate itself is no context.
        if not any(s < m.start() or e > m.end() for s, e in near):
            continue
        at = bisect.bisect_left(heads, m.end())  # of the base spans that start before its end, the one that ends last
        if at and reach[at - 1] > m.start():
            continue
        context = text[max(first, m.start() - CONTEXT) : m.start()], text[m.end() : min(last, m.end() + CONTEXT)]
        if novelty(context[1] + "\n" + context[0], value) >= bar:
            found.append((m.start(), 3, m.end()))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = NOVEL, dictionary: bytes | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of every row of docs.

    Defined cases: null text counts as empty; without spans the counts are zero, the hash is that of the empty string and
    spans is empty; repeated rows stay; spans of different kinds may overlap, novel ones overlap no base span; an empty
    table gives an empty result; other columns are ignored.
    """

    dictionary = identifier_dictionary(docs, text_col) if dictionary is None else dictionary

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        novelty = Novelty(dictionary)
        name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            hashes, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty, bar)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in (base if k < 3 else more)))
                hashes.append(hashlib.sha256(name(base).encode()).hexdigest() if base else empty)
                every.append(name(sorted(base + more)))
            yield {
                "doc_id": batch.column(0), **{f"n_{k}": pa.array(counts[i], pa.int64()) for i, k in enumerate(KINDS[:3])},
                "base_sha256": pa.array(hashes, pa.string()), "spans": pa.array(every, pa.string()), "n_novel": pa.array(counts[3], pa.int64()),
            }

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs, step, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint", [id_col, text_col])
