"""Record schemas: declaration, inference, validation, import, mapping to feature text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import trim_space

TEXT, CATEGORICAL, NUMERIC, IDENTIFIER, LABEL = KINDS = ("TEXT", "CATEGORICAL", "NUMERIC", "IDENTIFIER", "LABEL")
PUBLIC, PII = SENSITIVITIES = ("PUBLIC", "PII")
MAX_CATEGORIES, MIN_IDENTIFIER = 20, 4

#: What reads as a number: decimal or hexadecimal floating point, NaN, Infinity.
NUMBER = r"[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?\d+)[fFdD]?)"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    sensitivity: str = PUBLIC

    def __post_init__(self):
        if self.kind not in KINDS or self.sensitivity not in SENSITIVITIES:
            raise ValueError(f"bad field: {self}")


@dataclass(frozen=True)
class RecordSchema:
    """Ordered fields with exactly one label."""

    fields: tuple[Field, ...]

    def __post_init__(self):
        if sum(f.kind == LABEL for f in self.fields) != 1:
            raise ValueError("a schema has exactly one label field")

    @property
    def label(self) -> Field:
        return next(f for f in self.fields if f.kind == LABEL)

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @staticmethod
    def define() -> SchemaBuilder:
        return SchemaBuilder()


@dataclass
class SchemaBuilder:
    made: list[Field] = field(default_factory=list)

    def _add(self, name: str, kind: str, sensitivity: str = PUBLIC) -> SchemaBuilder:
        self.made.append(Field(name, kind, sensitivity))
        return self

    def text(self, name: str, sensitivity: str = PUBLIC) -> SchemaBuilder:
        return self._add(name, TEXT, sensitivity)

    def categorical(self, name: str, sensitivity: str = PUBLIC) -> SchemaBuilder:
        return self._add(name, CATEGORICAL, sensitivity)

    def numeric(self, name: str, sensitivity: str = PUBLIC) -> SchemaBuilder:
        return self._add(name, NUMERIC, sensitivity)

    def identifier(self, name: str, sensitivity: str = PII) -> SchemaBuilder:
        return self._add(name, IDENTIFIER, sensitivity)

    def label(self, name: str) -> SchemaBuilder:
        return self._add(name, LABEL)

    def build(self) -> RecordSchema:
        return RecordSchema(tuple(self.made))


def is_numeric(c: Column) -> Column:
    """Whether a string reads as a number."""
    return trim_space(c.cast("string")).rlike(rf"\A(?:{NUMBER})\z")


def infer(df: DataFrame, label: str) -> RecordSchema:
    """Kinds of all columns from their values, in one aggregation over the whole table."""
    names = [c for c in df.columns if c != label]
    value = {c: F.nullif(trim_space(df[c].cast("string")), F.lit("")) for c in names}
    code = {c: (F.length(value[c]) >= MIN_IDENTIFIER) & value[c].rlike(r"\A[\p{L}\d]+\z") & value[c].rlike(r"\p{Nd}") for c in names}
    parts = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(names):
        parts += [F.count(value[c]).alias(f"n{k}"), F.count_distinct(value[c]).alias(f"d{k}"), F.bool_and(value[c].rlike(rf"\A(?:{NUMBER})\z")).alias(f"num{k}"), F.bool_and(code[c]).alias(f"code{k}")]
    r = df.agg(*parts).first()
    if not r["rows"]:
        raise ValueError("cannot infer a schema from no records")
    made = []
    for c in df.columns:
        if c == label:
            made.append(Field(c, LABEL))
            continue
        k = names.index(c)
        n, d = r[f"n{k}"], r[f"d{k}"]
        if n and r[f"num{k}"]:
            made.append(Field(c, NUMERIC))
        elif 1 <= d < n and d <= MAX_CATEGORIES:
            made.append(Field(c, CATEGORICAL))
        elif n and d == n and r[f"code{k}"]:
            made.append(Field(c, IDENTIFIER, PII))
        else:
            made.append(Field(c, TEXT))
    if label not in df.columns:
        made.append(Field(label, LABEL))
    return RecordSchema(tuple(made))


def _have(df: DataFrame, name: str) -> Column:
    return df[name].cast("string") if name in df.columns else F.lit(None).cast("string")


def from_maps(df: DataFrame, map_col: str, schema: RecordSchema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of different shapes, as ``map<string,string>``: a column for each declared field, and in
    ``unknown_fields`` the names that a record has beyond them."""
    m, names = df[map_col], [f.name for f in schema.fields]
    unknown = F.array_except(F.map_keys(m), F.array(*[F.lit(n) for n in names]))
    return df.select(*keep, *[F.try_element_at(m, F.lit(n)).alias(n) for n in names], F.coalesce(unknown, F.array().cast("array<string>")).alias("unknown_fields"))


def validate(df: DataFrame, schema: RecordSchema, ignore: tuple[str, ...] = (), unknown_col: str | None = None) -> DataFrame:
    """Adds ``errors`` and ``warnings``.  Every column that the schema doesn't declare is an unknown field
    of every record; ``ignore`` names columns that are no fields (row numbers and the like).  ``unknown_col`` names a
    column with each record's own unknown fields (see ``from_maps``)."""
    label = schema.label.name
    errors = [F.when(F.coalesce(trim_space(_have(df, label)), F.lit("")) == "", F.lit(f"label '{label}' has no value"))]
    warnings = []
    for f in schema.fields:
        if f == schema.label:
            continue
        c = _have(df, f.name)
        warnings.append(F.when(c.isNull(), F.lit(f"'{f.name}' is not there")))
        if f.kind == NUMERIC:
            errors.append(F.when(c.isNotNull() & ~is_numeric(c), F.concat(F.lit(f"'{f.name}' is no number: "), c)))
    warnings += [F.lit(f"'{c}' is no field of the schema") for c in df.columns if schema.get(c) is None and c not in ignore and c != unknown_col]
    packed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    noted = packed(warnings)
    if unknown_col is not None:
        noted = F.concat(noted, F.transform(df[unknown_col], lambda n: F.concat(F.lit("'"), n, F.lit("' is no field of the schema"))))
    return df.withColumns({"errors": packed(errors), "warnings": noted})


def feature_text(df: DataFrame, schema: RecordSchema) -> Column:
    """Public fields but the label, in the order of the schema, trimmed, joined by one space."""
    parts = [F.nullif(trim_space(_have(df, f.name)), F.lit("")) for f in schema.fields if f.kind != LABEL and f.sensitivity != PII]
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def label_of(df: DataFrame, schema: RecordSchema) -> Column:
    return F.nullif(trim_space(_have(df, schema.label.name)), F.lit(""))


def map_records(df: DataFrame, schema: RecordSchema, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, feature_text, label (null if blank)."""
    return df.select(*keep, feature_text(df, schema).alias("feature_text"), label_of(df, schema).alias("label"))


@dataclass(frozen=True)
class Imported:
    """One annotated frame, and its views."""

    accepted: DataFrame
    rejected: DataFrame
    warnings: DataFrame


def import_records(df: DataFrame, schema: RecordSchema, keep: tuple[str, ...] = ()) -> Imported:
    """Accepted records are mapped, rejected ones keep their errors; warnings come from both."""
    checked = validate(df, schema, ignore=keep)
    ok = checked.filter(F.size("errors") == 0)
    return Imported(map_records(ok, schema, keep), checked.filter(F.size("errors") > 0), checked.select(*keep, F.explode("warnings").alias("warning")))
