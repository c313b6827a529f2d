"""Token patterns, slots and template clusters over token arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import CODES, GERMAN, TokenRules, encode_types, signature, spans, token_types

FIELD = "struct<name:string,value:string,start:int,end:int,confidence:double,group_index:int>"
ONE, OPTIONAL, ANY, MANY = "", "?", "*", "+"


@dataclass(frozen=True)
class TokenPattern:
    """Token types with quantifiers."""

    elements: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if not self.elements:
            raise ValueError("a pattern has at least one element")

    @classmethod
    def of(cls, *elements: str | tuple[str, str]) -> TokenPattern:
        return cls(tuple((e, ONE) if isinstance(e, str) else e for e in elements))

    def regex(self) -> str:
        return "".join(CODES[t] + q for t, q in self.elements)


def types_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["type"])


def find_all(tokens: Column, pattern: TokenPattern) -> Column:
    """Inclusive ranges of non-overlapping matches, leftmost and greedy; empty matches are skipped."""
    return spans(encode_types(types_of(tokens)), pattern.regex())


def matches_fully(types: Column, pattern: TokenPattern) -> Column:
    """Whether the first greedy match at the start takes in all tokens."""
    code, at_start = encode_types(types), rf"\A({pattern.regex()})"
    return code.rlike(at_start) & (F.length(F.regexp_extract(code, at_start, 1)) == F.length(code))


# -- slots -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class PositionalSlot:
    name: str
    index: int


@dataclass(frozen=True)
class KeyAnchoredSlot:
    name: str
    anchor: str
    target_type: str | None = None


@dataclass(frozen=True)
class RepeatingGroupSlot:
    components: tuple[tuple[str, str], ...]  # (field name, token type)

    def __post_init__(self):
        if not self.components:
            raise ValueError("a group has at least one component")


Slot = PositionalSlot | KeyAnchoredSlot | RepeatingGroupSlot


def _field(name: str, token: Column, group: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("name"), token["text"].alias("value"), token["start"].alias("start"), token["end"].alias("end"), F.lit(1.0).alias("confidence"), (F.lit(None).cast("int") if group is None else group.cast("int")).alias("group_index"))


def _one(name: str, token: Column) -> Column:
    return F.when(token.isNotNull(), F.array(_field(name, token))).otherwise(F.array().cast(f"array<{FIELD}>"))


def _slot(tokens: Column, slot: Slot) -> Column:
    if isinstance(slot, PositionalSlot):
        return _one(slot.name, F.get(tokens, F.lit(slot.index))) if slot.index >= 0 else F.array().cast(f"array<{FIELD}>")
    if isinstance(slot, KeyAnchoredSlot):
        bare = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t["text"], r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")))
        at = F.array_position(bare, slot.anchor.lower())
        rest = F.slice(tokens, at.cast("int") + 1, F.size(tokens))
        if slot.target_type is not None:
            rest = F.filter(rest, lambda t: t["type"] == slot.target_type)
        return _one(slot.name, F.when(at > 0, F.get(rest, F.lit(0))))
    found = spans(encode_types(types_of(tokens)), "".join(CODES[t] for _, t in slot.components))

    def groups(b: Column) -> Column:
        return F.flatten(F.transform(b["found"], lambda s, g: F.array(*[_field(n, F.get(b["tokens"], s["first"] + k), g) for k, (n, _) in enumerate(slot.components)])))

    # bound as one value: a lambda must not hold the tokenizer itself
    return F.get(F.transform(F.array(F.struct(tokens.alias("tokens"), found.alias("found"))), groups), F.lit(0))


def extract(tokens: Column, slots: list[Slot]) -> Column:
    """Fields of all slots, in their order: ``array<struct<name,value,start,end,confidence,group_index>>``."""
    if not slots:
        return F.array().cast(f"array<{FIELD}>")
    return F.concat(*[_slot(tokens, s).cast(f"array<{FIELD}>") for s in slots])


def values_of(fields: Column, name: str) -> Column:
    return F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: f["value"])


def first_of(fields: Column, name: str) -> Column:
    return F.get(values_of(fields, name), F.lit(0))


# -- templates ---------------------------------------------------------------------------------
def with_signature(df: DataFrame, text_col: str = "text", rules: TokenRules = GERMAN) -> DataFrame:
    return df.withColumn("signature", signature(token_types(F.col(text_col), rules)))


def template_clusters(df: DataFrame, id_col: str, text_col: str = "text", rules: TokenRules = GERMAN) -> DataFrame:
    """One row per signature: size and first member.  Membership stays a column of ``with_signature``, so no cluster is
    ever held in one row."""
    return with_signature(df, text_col, rules).groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.min(id_col).alias("first_id"))


def ranked_clusters(clusters: DataFrame) -> DataFrame:
    """Largest first, then by first member."""
    return clusters.orderBy(F.desc("size"), "first_id")
