"""Normalisation, typed tokens and signatures as Column expressions.

Offsets are code points (the same as UTF-16 units for characters of the basic plane).
Splitting and typing are regular expressions of the JVM; Python only comes in where a
position has to be carried from token to token (offsets, punctuation-aware splitting, spans).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, NUMERIC, ALPHANUMERIC, DATE, AMOUNT, SYMBOL, WORD_SYMBOL = TYPES = ("WORD", "NUMERIC", "ALPHANUMERIC", "DATE", "AMOUNT", "SYMBOL", "WORD_SYMBOL")
#: One letter for each type, for regular expressions over type sequences.
CODES = dict(zip(TYPES, "WNADMSX"))

#: Unicode white space: space separators and the controls that separate.
SPACE = r"\x09-\x0D\x1C-\x1F\p{Z}"
TOKEN_TYPE = "array<struct<pos:int,text:string,type:string,start:int,end:int>>"

Normalizer = Callable[[Column], Column]


@dataclass(frozen=True)
class TokenRules:
    """Ordered (regular expression, type) rules; the first that matches a whole token types it."""

    rules: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        bad = [t for _, t in self.rules if t not in TYPES]
        if bad:
            raise ValueError(f"unknown token types: {bad}")

    def first(self, *more: tuple[str, str]) -> TokenRules:
        """With custom rules in front."""
        return TokenRules((*more, *self.rules))


# The lexical forms of dates, amounts and numbers.
GERMAN = TokenRules(((r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}", DATE), (r"\d{1,3}(\.\d{3})*,\d{2}|\d+,\d{2}|\d+\.\d{2}", AMOUNT), (r"\d+([.,]\d{3})*", NUMERIC)))
US = TokenRules(((r"\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}", DATE), (r"\d{1,3}(,\d{3})*\.\d{2}|\d+\.\d{2}", AMOUNT), (r"\d+(,\d{3})*", NUMERIC)))
_GENERAL = ((r"\p{L}+", WORD), (r"[\p{L}\d]+", ALPHANUMERIC), (r"[^\p{L}\d\s]+", SYMBOL))


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize(c: Column) -> Column:
    """Runs of control characters and white space become one space; trimmed; lower case.  Idempotent."""
    return F.lower(trim_space(F.regexp_replace(c, r"[\p{Cntrl}\s]+", " ")))


def raw_tokens(c: Column) -> Column:
    """Maximal runs of non-white-space."""
    return F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def token_type(c: Column, rules: TokenRules = GERMAN) -> Column:
    """The type of one token."""
    out = None
    for pattern, kind in (*rules.rules, *_GENERAL):
        hit = c.rlike(rf"\A(?:{pattern})\z")
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit(WORD_SYMBOL))


def token_types(c: Column, rules: TokenRules = GERMAN) -> Column:
    return F.transform(raw_tokens(c), lambda t: token_type(t, rules))


def encode_types(types: Column) -> Column:
    """A type sequence as a string of one letter each."""
    pairs = [x for t in TYPES for x in (F.lit(t), F.lit(CODES[t]))]
    return F.array_join(F.transform(types, lambda t: F.element_at(F.create_map(*pairs), t)), "")


def signature(types: Column) -> Column:
    """``<word> <date>`` for a type sequence; empty for no tokens."""
    return F.array_join(F.transform(types, lambda t: F.concat(F.lit("<"), F.lower(t), F.lit(">"))), " ")


# -- with positions ----------------------------------------------------------------------------
def tokenize(c: Column, rules: TokenRules = GERMAN) -> Column:
    """White-space tokens with type and offsets: ``array<struct<pos,text,type,start,end>>``.  Each distinct token of a batch is typed once."""
    spec = tuple((python_pattern(p), k) for p, k in (*rules.rules, *_GENERAL))

    @F.arrow_udf(TOKEN_TYPE)
    def split(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import regex

        runs = regex.compile(f"[^{SPACE}]+").findall
        found, start, count = [], [], []
        for t in texts.to_pylist():
            # Python's split knows one more white-space character
            own = [] if t is None else runs(t) if "\x85" in t else t.split()
            at, place = 0, (t or "").index
            for w in own:
                at = place(w, at)
                start.append(at)
                at += len(w)
            found += own
            count.append(len(own))
        edge = np.r_[0, np.cumsum(np.array(count, np.int64))]
        words = pa.array(found, pa.string())
        code = words.dictionary_encode()
        tests = [(regex.compile(p).fullmatch, k) for p, k in spec]
        kind = [next((k for match, k in tests if match(w)), WORD_SYMBOL) for w in code.dictionary.to_pylist()]
        first = np.array(start, np.int32)
        pos = (np.arange(len(first)) - np.repeat(edge[:-1], count)).astype(np.int32)
        last = first + pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        fields = [pa.array(pos), words, pa.array(kind, pa.string()).take(code.indices), pa.array(first), pa.array(last)]
        tokens = pa.StructArray.from_arrays(fields, ["pos", "text", "type", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), tokens, mask=texts.is_null() if texts.null_count else None)

    return split(c)


#: The JVM's ASCII classes.
_ASCII = {"d": "0-9", "s": r" \t\n\x0B\f\r", "w": "A-Za-z0-9_"}


def python_pattern(java: str) -> str:
    """A rule for Python's ``regex``: digits, spaces and word characters are ASCII, as in the JVM."""
    out, inside, at = [], False, 0
    while at < len(java):
        c, at = java[at], at + 1
        if c == "\\" and at < len(java):
            e, at = java[at], at + 1
            plain = _ASCII.get(e)
            out.append(c + e if plain is None else plain if inside else f"[{plain}]")
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
    return "".join(out)


def punctuation_tokens(text: str, rules: Sequence[tuple[object, str]], general: Sequence[tuple[object, str]]) -> list[tuple[str, str, int, int]]:
    """Tokens of one text: the longest rule at a place, else letters and digits, else symbols."""
    import regex

    run, marks, space = _RUNS(regex)
    out, at, n = [], 0, len(text)
    while at < n:
        if m := space.match(text, at):
            at = m.end()
            continue
        end = max((m.end() for r, _ in rules if (m := r.match(text, at))), default=at)
        if end > at:
            piece = text[at:end]
            kind = next((k for r, k in (*rules, *general) if r.fullmatch(piece)), WORD_SYMBOL)
        elif m := run.match(text, at):
            end, piece = m.end(), m[0]
            kind = WORD if general[0][0].fullmatch(piece) else NUMERIC if all(x.isdecimal() for x in piece) else ALPHANUMERIC
        else:
            end = marks.match(text, at).end()
            piece, kind = text[at:end], SYMBOL
        out.append((piece, kind, at, end))
        at = end
    return out


def _RUNS(regex):
    return regex.compile(r"[\p{L}\p{Nd}]+"), regex.compile(rf"[^\p{{L}}\p{{Nd}}{SPACE}]+"), regex.compile(f"[{SPACE}]+")


def tokenize_punctuation(c: Column, rules: TokenRules = GERMAN) -> Column:
    """Punctuation-aware tokens, in the same form as ``tokenize``."""
    spec = tuple((python_pattern(p), k) for p, k in rules.rules)

    @F.arrow_udf(TOKEN_TYPE)
    def split(texts):
        import pyarrow as pa
        import regex

        own = [(regex.compile(p), k) for p, k in spec]
        general = [(regex.compile(python_pattern(p)), k) for p, k in _GENERAL]
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("text", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = [None if t is None else [{"pos": i, "text": x, "type": k, "start": s, "end": e} for i, (x, k, s, e) in enumerate(punctuation_tokens(t, own, general))] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    return split(c)


def spans(encoded: Column, pattern: str) -> Column:
    """Leftmost, greedy, non-overlapping, non-empty matches over encoded types: ``array<struct<first,last>>``, inclusive."""

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def find(codes):
        import re

        import pyarrow as pa

        search = re.compile(pattern).finditer
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.array([None if c is None else [{"first": m.start(), "last": m.end() - 1} for m in search(c) if m.end() > m.start()] for c in codes.to_pylist()], kind)

    return find(encoded)
