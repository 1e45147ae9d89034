"""Test data per test case: fields from text, then valid, invalid and boundary records.

Everything is a narrow projection of the case row (array expressions and one explode): a record is
a function of the seed, the case and its own number, so no step needs a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.draws import Draws
from corpusmill.functions.fieldtypes import DATA_TYPES, FIELDS_TYPE, data_fields, detect_field_type, extract_fields
from corpusmill.functions.generators import BOUNDARY_TYPE, boundary_cases, field_value, typed_value
from corpusmill.functions.responses import parse_fields, strip_fences
from corpusmill.operators.rows import unnest

# --- fixed values -----------------------------------------------------------------------------
NUM_VALID, NUM_INVALID = 5, 3
NUM_VALID_PER_CASE, NUM_INVALID_PER_CASE = 3, 2
# ----------------------------------------------------------------------------------------------

def case_fields(cases: DataFrame, text: str = "test_case", response: str | None = None) -> DataFrame:
    """Add ``fields``: those of a model response when it parses, else those the text mentions.

    Names that describe the test case itself are dropped.
    """
    found = extract_fields(F.col(text))  # mentions are never names of the test case itself
    if response is None:
        return cases.withColumn("fields", found)
    staged = cases.withColumn("_clean", strip_fences(F.col(response)))
    staged = staged.withColumn("_answered", parse_fields(F.col("_clean")))
    return staged.withColumn("fields", F.coalesce(data_fields(F.col("_answered")), found)).drop("_clean", "_answered")


def field_table(cases: DataFrame, case_id: str = "case_id") -> DataFrame:
    """One row per case and field."""
    return unnest(cases, [case_id], F.col("fields"), "pos", "_f").select(case_id, "pos", "_f.*")


def unknown_types(fields: DataFrame) -> DataFrame:
    """Fields whose type is not in the registry."""
    known = fields.sparkSession.createDataFrame([(t,) for t in DATA_TYPES], "data_type string")
    return fields.join(F.broadcast(known), "data_type", "left_anti")  # 15 rows


def merge_fields(fields: DataFrame, case_id: str = "case_id") -> DataFrame:
    """One definition per field name: that of the first case that has it."""
    first = F.min_by(F.struct("data_type", "required", "constraints"), F.struct(case_id, "pos"))
    return fields.groupBy("field_name").agg(first.alias("_f")).select("field_name", "_f.*")


def _resolved_type(field: Column) -> Column:
    return F.coalesce(field["data_type"], detect_field_type(field["field_name"]))


def _record_slots(num_valid: int, num_invalid: int, kinds: tuple[str, ...]) -> Column:
    """The records of every case as a constant array; boundary rows share one slot."""
    numbers = {"valid": range(num_valid), "invalid": range(num_invalid), "boundary": range(1)}
    slots = [F.struct(F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("record_id")) for kind in kinds for n in numbers[kind]]
    return F.array(*slots).cast("array<struct<kind:string,record_id:bigint>>")


def records(
    cases: DataFrame,
    num_valid: int = NUM_VALID,
    num_invalid: int = NUM_INVALID,
    case_id: str = "case_id",
    seed: int = 0,
    as_of: Column | None = None,
    kinds: tuple[str, ...] = ("valid", "invalid", "boundary"),
) -> DataFrame:
    """Long record table of every case, one row per case, kind, record and field.

    An invalid record has exactly one bad field, taken in turn; boundary rows stand for
    themselves, numbered within their field.  Cases without fields give no rows.
    """
    rows = unnest(cases, [case_id, "fields"], _record_slots(num_valid, num_invalid, kinds), "_n", "_r")
    kept = [case_id, "_r.kind", "_r.record_id", F.size("fields").alias("_n_fields")]
    rows = unnest(rows, kept, F.col("fields"), "pos", "_f").withColumn("data_type", _resolved_type(F.col("_f")))
    limits = F.col("_f.constraints")
    on_boundary = F.col("kind") == "boundary"
    if "boundary" in kinds:
        drawn_row = F.array(F.struct(F.lit(None), F.lit(None), F.lit(False))).cast(BOUNDARY_TYPE)
        cases_of = F.when(on_boundary, boundary_cases(F.col("data_type"), limits)).otherwise(drawn_row)
        rows = unnest(rows, rows.columns, cases_of, "_b_no", "_b")
        rows = rows.withColumn("record_id", F.when(on_boundary, F.col("_b_no").cast("bigint")).otherwise(F.col("record_id")))
        boundary = (F.col("_b.value"), F.col("_b.case_label"), F.col("_b.is_invalid"))
    else:
        boundary = (F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False))
    bad = (F.col("kind") == "invalid") & (F.pmod(F.col("record_id"), F.col("_n_fields")) == F.col("pos"))
    name = F.col("_f.field_name")
    record = F.concat_ws("/", F.col(case_id).cast("string"), "kind", F.col("record_id").cast("string"))
    draws = Draws(seed, record, name)
    rows = rows.withColumns({"_d0": draws.digest(0), "_d1": draws.digest(1)})  # shared by all types
    good = ~bad if "invalid" in kinds else F.lit(True)
    drawn = field_value(F.col("data_type"), good, draws.holding(F.col("_d0"), F.col("_d1")), limits, as_of)
    return rows.select(
        case_id, "kind", "record_id", "pos", name.alias("field_name"), "data_type",
        F.when(on_boundary, boundary[0]).otherwise(drawn).alias("value"),
        F.when(bad, name).alias("invalid_field"),
        F.when(bad, F.concat(F.lit("Invalid "), name)).alias("reason"),
        boundary[1].alias("case_label"), (bad | boundary[2]).alias("is_invalid"),
    )


def wide_records(
    keys: DataFrame,
    record: str,
    fields: list[tuple[str, str]],
    seed: int = 0,
    valid: bool = True,
    constraints: dict[str, Column] | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """One record per row of ``keys`` with a typed column per (name, type) of a known field list.

    With ``valid=False`` every record has one bad field, taken in turn by the record number; the
    values are then text, since bad values need not fit the type.
    """
    bounds = constraints or {}
    columns = []
    for position, (name, data_type) in enumerate(fields):
        draws = Draws(seed, F.col(record), F.lit(name))
        good = typed_value(data_type, draws, True, bounds.get(name), as_of)
        if valid:
            columns.append(good.alias(name))
            continue
        bad = typed_value(data_type, draws, False, bounds.get(name), as_of)
        turn = F.pmod(F.col(record), F.lit(len(fields))) == position
        columns.append(F.when(turn, bad.cast("string")).otherwise(good.cast("string")).alias(name))
    if not valid:
        names = F.array(*[F.lit(name) for name, _ in fields])
        chosen = F.get(names, F.pmod(F.col(record), F.lit(len(fields))).cast("int"))
        columns += [chosen.alias("_invalid_field"), F.concat(F.lit("Invalid "), chosen).alias("_reason")]
    return keys.select(record, *columns)


def dataset_summary(
    cases: DataFrame, num_valid: int = NUM_VALID, num_invalid: int = NUM_INVALID, case_id: str = "case_id"
) -> DataFrame:
    """Counts per case, zero for cases without fields."""
    has_fields = F.size("fields") > 0
    boundary = F.aggregate(
        F.col("fields"), F.lit(0),
        lambda n, f: n + F.size(boundary_cases(_resolved_type(f), f["constraints"])),
    )
    return cases.select(
        case_id,
        F.when(has_fields, num_valid).otherwise(0).cast("bigint").alias("total_valid"),
        F.when(has_fields, num_invalid).otherwise(0).cast("bigint").alias("total_invalid"),
        boundary.cast("bigint").alias("total_boundary"),
        F.size("fields").cast("bigint").alias("total_fields"),
    )


def combined_summary(
    cases: DataFrame, num_valid: int = NUM_VALID_PER_CASE, num_invalid: int = NUM_INVALID_PER_CASE,
    case_id: str = "case_id",
) -> DataFrame:
    """Counts over all cases; a field name counts once."""
    per_case = dataset_summary(cases.select(case_id, "fields"), num_valid, num_invalid, case_id)
    totals = per_case.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("total_valid", "total_invalid", "total_boundary")],
        F.count(F.lit(1)).alias("test_cases_processed"),
    )
    names = unnest(cases, [], F.col("fields"), "_n", "f").agg(F.countDistinct("f.field_name").alias("total_fields"))
    return totals.withColumn("_one", F.lit(1)).join(names.withColumn("_one", F.lit(1)), "_one").drop("_one")


def empty_fields() -> Column:
    return F.array().cast(FIELDS_TYPE)
