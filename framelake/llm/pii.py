"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs before a
digit, neighbouring digits, digits before a dot, URL schemes and identifier cues. From each anchor
a local parser walks outwards to the boundaries of the candidate and validates it. Parsers of one
kind go left to right and never look at text that an earlier candidate of the kind has used, so
each character is visited a bounded number of times, also in texts that consist of anchors only.

Kinds, in the order of the result:

* `email`, `ip`, `card`, `phone`: what a left-to-right search for the four base patterns finds,
  candidates with bad parts, digit counts or checksums being dropped and not tried again.
* `url`: an address with a scheme that names a user (`scheme://user@host`, `mailto:user@host`).
* `account`: the value behind an identifier cue (`iban`, `account`, `token`, `password` ...): an
  IBAN with a right checksum, or a run of at least six letters and digits with a digit in it.

Null texts count as empty and have no spans. Offsets are code points, the end exclusive. Repeated
rows each give a row.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "password", "passwd", "token", "secret", "api_key", "apikey")

Span = tuple[int, int]

_DIGITS = frozenset("0123456789")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"[ ().0-9-]*")
_USER = re.compile(r"[^\s/?#@\"'<>]{1,256}@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_VALUE = re.compile(r"(?:[ \t_-]?(?:no|number|nr|id|key))?\.?[ \t]{0,3}[:=#]?[ \t]{0,3}[\"']?")
_WORD = re.compile(r"[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def email_at(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """The address around the at-sign, not reaching left of `free`; where the next may begin."""
    left = at
    while left > free and _LOCAL.match(text[left - 1]):
        left -= 1
    domain = _DOMAIN.match(text, at + 1) if left < at else None
    return ((left, domain.end()), domain.end()) if domain else (None, free)


def run_start(text: str, at: int, free: int, joins: str) -> int:
    """Start of the run of digits, linked by single characters of `joins`, that holds the digit at `at`."""
    while True:
        if at > free and text[at - 1] in _DIGITS:
            at -= 1
        elif at - 1 > free and text[at - 1] in joins and text[at - 2] in _DIGITS:
            at -= 2
        else:
            return at


def ips_at(text: str, at: int, free: int) -> tuple[list[Span], int]:
    """Quadruples of a dotted run, cut off from its left."""
    run = _DOTTED.match(text, run_start(text, at, free, "."))
    parts = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, *run.span())]
    spans = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        if all(len(value := text[a:b].lstrip("0")) <= 3 and int(value or "0") <= 255 for a, b in four):
            spans.append((four[0][0], four[3][1]))
    return spans, run.end()


def card_at(text: str, at: int, free: int) -> tuple[Span | None, int]:
    chain = _CHAIN.match(text, run_start(text, at, free, " -"))
    digits = chain.group().replace(" ", "").replace("-", "")
    good = 13 <= len(digits) <= 19 and luhn(digits)
    return (chain.span() if good else None), chain.end()


def phone_at(text: str, plus: int, free: int) -> tuple[Span | None, int]:
    run = _DIAL.match(text, plus + 2)
    last = run.end() - 1
    while last > plus + 2 and text[last] not in _DIGITS:
        last -= 1
    if last <= plus + 2:
        return None, free
    digits = sum(c in _DIGITS for c in text[plus : last + 1])
    return ((plus, last + 1) if 9 <= digits <= 15 else None), last + 1


def url_at(text: str, start: int, after: int, free: int) -> tuple[Span | None, int]:
    """`start`, `after`: of the scheme."""
    rest = _USER.match(text, after)
    if not rest:
        return None, free
    end = rest.end()
    while text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end), end


def account_at(text: str, after: int, free: int) -> tuple[Span | None, int]:
    """The value that follows a cue ending at `after`."""
    begin = _VALUE.match(text, after).end()
    if begin == after or begin < free:
        return None, free
    iban = _IBAN.match(text, begin)
    if iban:
        words = iban.group().split(" ")
        for n in range(len(words), 0, -1):  # words of the sentence may follow
            candidate = " ".join(words[:n])
            if iban_valid(candidate):
                return (begin, begin + len(candidate)), begin + len(candidate)
    word = _WORD.match(text, begin)
    if word and len(word.group()) >= 6 and any(c in _DIGITS for c in word.group()):
        return word.span(), word.end()
    return None, free


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchor -> kinds. Letters are looked up in lower case."""
    anchors: dict[str, list[str]] = {"@": ["email"]}
    for digit in "0123456789":
        anchors[f"+{digit}"] = ["phone"]
        anchors[f"{digit}."] = ["ip"]
        for other in "0123456789":
            anchors[digit + other] = ["card"]
            anchors[f"{digit} {other}"] = ["card"]
            anchors[f"{digit}-{other}"] = ["card"]
    for scheme in SCHEMES:
        anchors[scheme] = ["url"]
    for cue in CUES:
        anchors[cue] = ["account"]
    found = ahocorasick.Automaton()
    for anchor, kinds in anchors.items():
        found.add_word(anchor, (len(anchor), kinds[0]))
    found.make_automaton()
    return found


_UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def find_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, in order and without overlaps within a kind."""
    spans: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in automaton().iter(text.translate(_UPPER)):
        start, after = last - length + 1, last + 1
        if start < free[kind]:
            continue
        if kind == "ip":
            more, free[kind] = ips_at(text, start, free[kind])
            spans[kind] += more
            continue
        if kind == "email":
            span, free[kind] = email_at(text, start, free[kind])
        elif kind == "card":
            span, free[kind] = card_at(text, start, free[kind])
        elif kind == "phone":
            span, free[kind] = phone_at(text, start, free[kind])
        elif kind == "url":
            span, free[kind] = url_at(text, start, after, free[kind])
        else:
            span, free[kind] = account_at(text, after, free[kind])
        if span:
            spans[kind].append(span)
    return spans


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    merged: list[list] = []
    for start, end, kind in sorted((s, e, k) for k, all_ in spans.items() for s, e in all_):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:] if merged else text


def span_list(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def _mapped(column: str, make: Callable[[str], dict], schema: pa.Schema):
    """Batches with the text column replaced by the fields that `make` gives for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = [make(text.as_py() or "") for text in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), *(pa.array([m[f.name] for m in made], f.type) for f in schema)],
                [*(batch.schema.field(i).name for i in rest), *schema.names],
            )

    return run


_FOUND = pa.schema(
    [(f"n_{kind}", pa.int64()) for kind in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def _found(text: str) -> dict:
    spans = find_spans(text)
    return {f"n_{kind}": len(spans[kind]) for kind in BASE} | {
        "base_sha256": hashlib.sha256(span_list(spans, BASE).encode()).hexdigest(),
        "spans": span_list(spans, KINDS),
    }


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans."""
    return docs.select("doc_id", "text").mapInArrow(
        _mapped("text", _found, _FOUND),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def _masked(text: str) -> dict:
    return {"text": masked(text, find_spans(text))}


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` masked and `n_chars`, where there is one, recounted.

    Null texts stay null; other columns and their order stay as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), F.col("text").isNull().alias("none"), "text")
    kept = texts.mapInArrow(
        _mapped("text", _masked, pa.schema([("text", pa.string())])),
        texts.select("rest", "none", F.coalesce("text", F.lit("")).alias("text")).schema,
    )
    text = F.when(~F.col("none"), F.col("text"))
    out = kept.select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), text.alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
