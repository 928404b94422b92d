"""Tabular preparation: coercion, recoding, missingness, rule flags, validation, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of the raw files and their labels.
CODES = {
    "Sex": {1.0: "M", 0.0: "F"},
    "ChestPainType": {1.0: "TA", 2.0: "ATA", 3.0: "NAP", 4.0: "ASY"},
    "RestingECG": {0.0: "Normal", 1.0: "ST", 2.0: "LVH"},
    "ExerciseAngina": {0.0: "N", 1.0: "Y"},
    "ST_Slope": {1.0: "Up", 2.0: "Flat", 3.0: "Down"},
}
#: Column order of raw files.
RAW_COLUMNS = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal", "num"]


def number(c: Column) -> Column:
    """Lenient number: what can't be read is null."""
    return c.try_cast("double")


def coded(c: Column, codes: dict[float, str]) -> Column:
    value = number(c)
    out = F.lit(None).cast("string")
    for code, label in codes.items():
        out = F.when(value == code, label).otherwise(out)
    return out


def recode(raw: DataFrame, source: str | None = None) -> DataFrame:
    """The 14 raw string columns as 12 typed ones, the source with them; unknown codes are null."""
    made = {
        "Age": F.bround(number(F.col("age"))).cast("int"),
        "Sex": coded(F.col("sex"), CODES["Sex"]),
        "ChestPainType": coded(F.col("cp"), CODES["ChestPainType"]),
        "RestingBP": number(F.col("trestbps")),
        "Cholesterol": number(F.col("chol")),
        "FastingBS": number(F.col("fbs")).cast("int"),
        "RestingECG": coded(F.col("restecg"), CODES["RestingECG"]),
        "MaxHR": number(F.col("thalach")),
        "ExerciseAngina": coded(F.col("exang"), CODES["ExerciseAngina"]),
        "Oldpeak": number(F.col("oldpeak")),
        "ST_Slope": coded(F.col("slope"), CODES["ST_Slope"]),
        "HeartDisease": binary_target(number(F.col("num"))),
    }
    return raw.select(*[v.alias(k) for k, v in made.items()], (F.lit(source) if source else F.col("source")).alias("source"))


def binary_target(c: Column) -> Column:
    return (F.coalesce(c, F.lit(0)) >= 1).cast("int")


def sentinel_to_null(df: DataFrame, column: str, sentinel=0) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel)))


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """<column>_was_missing for each, as 0 or 1; one that is there already stays."""
    return df.withColumns({f"{c}_was_missing": F.isnull(c).cast("byte") for c in columns if f"{c}_was_missing" not in df.columns})


def missing_label(df: DataFrame, columns: list[str], label: str = "Missing") -> DataFrame:
    return df.fillna(label, columns)


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def clean(df: DataFrame, sentinel: str, indicators: list[str], labels: list[str], numbers: list[str]) -> DataFrame:
    """The four steps in their order; running it again changes nothing."""
    lacking = [c for c in {sentinel, *indicators, *labels, *numbers} if c not in df.columns]
    if lacking:
        raise KeyError(f"columns are missing: {sorted(lacking)}")
    return to_double(missing_label(missing_indicators(sentinel_to_null(df, sentinel), indicators), labels), numbers)


def band(value: Column, cuts: list[tuple[float, float, str]], unknown: str = "unknown") -> Column:
    """The label of the half-open range that holds value."""
    out = F.lit(unknown)
    for low, high, label in cuts:
        out = F.when((value >= low) & (value < high), label).otherwise(out)
    return out


#: The age bands.
AGE_BANDS = [(0, 50, "<50"), (50, 70, "50-70"), (70, 200, ">=70")]


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def triage_rules() -> dict[str, Column]:
    """The limits of the flags."""
    c = F.col
    return {
        "cholesterol_missing_sentinel": c("Cholesterol") == 0,
        "oldpeak_negative": c("Oldpeak") < 0,
        "resting_bp_extreme": (c("RestingBP") < 90) | (c("RestingBP") > 180),
        "age_outside_training_range": (c("Age") < 28) | (c("Age") > 77),
    }


def triage_summary(found: Column) -> Column:
    """A line about a record (columns of the patient table) and its flags. Its wording."""
    parts = ["Triage: ", F.col("Age"), "y ", F.col("Sex"), ", chest pain=", F.col("ChestPainType"), ", resting BP=", F.col("RestingBP"), ", chol=", F.col("Cholesterol"), ", max HR=", F.col("MaxHR"), ", ST slope=", F.col("ST_Slope"), ". "]
    said = F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(said, F.when(F.size(found) == 0, "No sanity flags.").otherwise(F.concat(F.lit("Flags: "), F.array_join(found, ", "), F.lit("."))))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows with the violated rules' names); a null condition violates."""
    judged = df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


_KINDS = {"string": T.StringType, "number": T.NumericType, "integer": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": T.StructType}


def schema_violations(value: Column, schema: dict, kind: T.DataType, path: Column | str = "$") -> Column:
    """The violations ("path: rule") of a value against a JSON schema, compiled to one array expression.

    Rules: type, enum, const, pattern, minimum, maximum, minLength, maxLength, minItems, maxItems, uniqueItems, items,
    properties and required, at any depth; array paths have places from 0. A null is an absent value: it violates only
    where its name is required, and inside an array unless its type may be null. Other keys of the schema are an error."""
    known = {"type", "enum", "const", "pattern", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "items", "properties", "required", "title", "description", "$schema"}
    if unknown := set(schema) - known:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    path = F.lit(path) if isinstance(path, str) else path
    there, none = value.isNotNull(), F.array().cast("array<string>")
    said = lambda rule, broken: F.when(there & broken, F.array(F.concat(path, F.lit(f": {rule}")))).otherwise(none)
    types = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
    plain = [t for t in types if t != "null"]
    if plain and not any(isinstance(kind, _KINDS[t]) for t in plain):
        return said("type", F.lit(True))
    out = []
    if plain == ["integer"]:
        out.append(said("type", value.cast("double") != F.floor(value.cast("double"))))
    if "enum" in schema:
        out.append(said("enum", ~value.isin([v for v in schema["enum"] if v is not None])))
    if "const" in schema:
        out.append(said("const", value != F.lit(schema["const"])))
    if "pattern" in schema:
        out.append(said("pattern", ~value.rlike(schema["pattern"])))
    bounds = {"minimum": lambda v, n: v < n, "maximum": lambda v, n: v > n, "minLength": lambda v, n: F.length(v) < n, "maxLength": lambda v, n: F.length(v) > n, "minItems": lambda v, n: F.size(v) < n, "maxItems": lambda v, n: F.size(v) > n}
    out += [said(rule, broken(value, schema[rule])) for rule, broken in bounds.items() if rule in schema]
    if schema.get("uniqueItems"):
        out.append(said("uniqueItems", F.size(F.array_distinct(value)) < F.size(value)))
    if "items" in schema and isinstance(kind, T.ArrayType):
        inner, of = schema["items"], kind.elementType
        may_be_null = "null" in ([inner["type"]] if isinstance(inner.get("type"), str) else inner.get("type", ["null"]))

        def item(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            found = schema_violations(x, inner, of, at)
            return found if may_be_null else F.when(x.isNull(), F.array(F.concat(at, F.lit(": type")))).otherwise(found)

        out.append(F.when(there, F.flatten(F.transform(value, item))).otherwise(none))
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        for name in schema.get("required", []):
            lacking = value[name].isNull() if name in fields else F.lit(True)
            out.append(F.when(there & lacking, F.array(F.concat(path, F.lit(f".{name}: required")))).otherwise(none))
        out += [schema_violations(value[name], inner, fields[name], F.concat(path, F.lit(f".{name}"))) for name, inner in schema.get("properties", {}).items() if name in fields]
    return F.concat(*out) if out else none


def validate_schema(df: DataFrame, schema: dict) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows with violations) of rows as objects of a JSON schema; see schema_violations."""
    judged = df.withColumn("violations", schema_violations(F.struct(*[F.col(f"`{c}`") for c in df.columns]), schema, df.schema))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def risk_terms() -> dict[str, Column]:
    """The weights of the additive demonstration score."""
    c = F.col
    return {
        "Age": (c("Age") - 50) * 0.04,
        "Sex": F.when(c("Sex") == "M", 0.4).otherwise(0.0),
        "ChestPainType": F.when(c("ChestPainType") == "ASY", 1.2).when(c("ChestPainType") == "TA", 0.6).otherwise(0.0),
        "ExerciseAngina": F.when(c("ExerciseAngina") == "Y", 0.7).otherwise(0.0),
        "ST_Slope": F.when(c("ST_Slope") == "Down", 0.9).when(c("ST_Slope") == "Flat", 0.6).otherwise(0.0),
        "Cholesterol": F.when(c("Cholesterol") == 0, 0.05).otherwise((c("Cholesterol") - 200) * 0.001),
        "MaxHR": -(c("MaxHR") - 140) * 0.005,
    }


def risk_probability(terms: dict[str, Column], base: float = -2.5) -> Column:
    z = sum(terms.values(), F.lit(base))
    return 1 / (1 + F.exp(-z))


def contributions(terms: dict[str, Column], k: int = 6) -> Column:
    """The k largest terms by size, ties in the given order."""
    every = F.array(*[F.struct((-F.abs(v)).alias("size"), F.lit(i).alias("place"), F.lit(n).alias("feature"), v.cast("double").alias("contribution")) for i, (n, v) in enumerate(terms.items())])
    return F.slice(F.transform(F.array_sort(every), lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"))), 1, k)


def model_contributions(features: Column, weights: list[float], names: list[str], k: int = 6, signs: bool = False) -> Column:
    """Weight times value for each feature, the k largest by size; empty when the lengths differ. With signs
    (weights are a forest's importances) weight times the value's sign, 0 for values within 1e-9 of 0."""
    if signs:
        features = F.transform(features, lambda x: F.when(F.abs(x) > 1e-9, F.signum(x)).otherwise(0.0))
    if len(weights) != len(names):
        return F.array().cast("array<struct<feature:string,contribution:double>>")
    parts = F.zip_with(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.array(*[F.lit(n) for n in names]), lambda v, n: F.struct((-F.abs(v)).alias("size"), n.alias("feature"), v.alias("contribution")))
    made = F.slice(F.transform(F.array_sort(parts), lambda s: F.struct(s["feature"].alias("feature"), s["contribution"].alias("contribution"))), 1, k)
    return F.when(F.size(features) == len(weights), made).otherwise(F.array().cast("array<struct<feature:string,contribution:double>>"))


def risk_band(p: Column, low: float = 0.05, high: float = 0.10) -> Column:
    """The limits of the bands."""
    return F.when(p >= high, "high").when(p <= low, "low").otherwise("intermediate")


def scrub(df: DataFrame, key: str = "patient", mark: str = "<scrubbed>") -> DataFrame:
    """Every value under a field of that name (any case), however deep in structs and arrays, becomes
    the mark; in string maps the value of such a key does."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            parts = [(F.lit(mark) if f.name.lower() == key else walk(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(F.lower(k) == key, F.lit(mark)).otherwise(v))
        return c

    return df.select(*[(F.lit(mark) if f.name.lower() == key else walk(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields])


def judge_json(raw: Column) -> Column:
    """Struct (alignment, quality, passed) of the first {...} in a text; what can't be read is 1, 1."""
    found = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*?\}", 0), "alignment INT, quality INT")
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)), F.lit(5))
    a, q = clamp(found["alignment"]), clamp(found["quality"])
    return F.struct(a.alias("alignment"), q.alias("quality"), ((a >= 4) & (q >= 4)).alias("passed"))


def source_profile(df: DataFrame, by: str, target: str) -> DataFrame:
    made = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(target)).alias("pct_positive"))
    return made.withColumn("pct_of_total", 100 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), by)


def missing_rates(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.round(100 * F.avg(F.isnull(c).cast("int")), 1).alias(c) for c in columns])


def sentinel_audit(df: DataFrame, column: str, by: str, sentinel=0) -> DataFrame:
    zero = F.count_if(F.col(column) == sentinel)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), zero.alias("n_zero"), (100 * zero / F.count(F.lit(1))).alias("pct_zero"))


def melt_numeric(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double") for c in columns]).unpivot(ids, columns, "feature", "value").dropna(subset=["value"])


def level_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], columns, "feature", "level")
    counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair, over the rows where both are there; one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("r")) for i, (a, b) in enumerate(pairs)])))


def schema_diff(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    return {"missing": sorted(set(expected) - set(df.columns)), "extra": sorted(set(df.columns) - set(expected))}


def histogram(df: DataFrame, columns: list[str], by: str, bins: int, low: float, high: float) -> DataFrame:
    long = melt_numeric(df, [by], columns)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / ((high - low) / bins)))).cast("int")
    return long.groupBy(by, "feature", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
