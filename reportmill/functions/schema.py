"""The master record's template, and what is generated from it: types, coercion, the log of dropped values, missing fields."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from reportmill.functions import dates as D
from reportmill.functions import text as T

# The record's sections, fields and leaf types, in the order of output. A leaf with bars is a choice.
_STATUS, _SEVERITY, _NEW = "Open | Closed | Partially Remediated", "Critical | High | Medium | Low", "New | Repeat"
_PERSON = {"name": "string", "auditing_team_sr_no": "number"}
TEMPLATE: dict[str, Any] = {
    "report_meta": {
        "report_id": "string", "report_title": "string", "report_type": "string", "report_release_date": "YYYY-MM-DD", "report_version": "string",
        "audit_type": "string", "audit_period": {"from": "YYYY-MM-DD", "to": "YYYY-MM-DD"}, "classification": "string",
    },
    "document_control": {
        "document_title": "string", "document_id": "string", "document_version": "string",
        "prepared_by": _PERSON, "reviewed_by": _PERSON, "approved_by": _PERSON, "released_by": _PERSON, "release_date": "YYYY-MM-DD",
        "change_history": [{"version": "string", "date": "YYYY-MM-DD", "remarks": "string"}],
        "distribution_list": [{"name": "string", "organization": "string", "designation": "string", "email": "string"}],
    },
    "engagement_scope": {
        "assets": [{"sr_no": "number", "asset_description": "string", "url": "string", "criticality": "string", "internal_ip": "string", "public_ip": "string", "in_scope_functions": "string"}],
        "scope_updated_till": "YYYY-MM-DD", "exclusions": ["string"],
        "testing_credentials": [{"role": "string", "account_identifier": "string", "auth_type": "string", "purpose": "string"}],
    },
    "auditing_team": [{"sr_no": "number", "name": "string", "designation": "string", "email": "string", "certifications": "string"}],
    "audit_timeline": {"assessment_start_date": "YYYY-MM-DD", "assessment_end_date": "YYYY-MM-DD"},
    "methodology": {"standards_referred": ["string"]},
    "tools_used": [{"sr_no": "number", "tool_name": "string", "version": "string", "license_type": "Open Source | Licensed"}],
    "executive_summary": {
        "total_findings": "number", "severity_count": {"critical": "number", "high": "number", "medium": "number", "low": "number"}, "narrative": "string",
        "summary_table": [{"sr_no": "number", "finding_id": "string", "affected_asset": "string", "title": "string", "cwe": "string", "severity": _SEVERITY, "status": _STATUS, "new_or_repeat": _NEW}],
    },
    "detailed_observations": [
        {
            "finding_id": "string", "title": "string", "status": _STATUS, "severity": _SEVERITY, "impact_level": "Major | Moderate | Minor", "likelihood_level": "Easy | Moderate | Hard",
            "cve_id": ["string"], "cvss_score": "number", "cvss_vector": "string", "severity_rationale": "string", "reported_epss_score": "number", "observation_date": "YYYY-MM-DD",
            "cwe": ["string"], "affected_asset": ["string"], "regulatory_references": ["string"], "observation_description": "string", "preconditions": "string",
            "proof_of_concept": [{"sr_no": "number", "type": "image | text", "reference": "string", "capture_date": "YYYY-MM-DD", "is_retest": "boolean", "redacted": "Yes | No | NA", "description": "string"}],
            "impact": "string", "likely_root_cause": "string", "recommendation": "string", "reference": "string", "new_or_repeat": _NEW,
        }
    ],
    "appendices": {
        "risk_rating_criteria": [{"rating": "string", "description": "string", "impact_level": "string", "likelihood_level": "string"}],
        "retest_closure": [{"finding_id": "string", "retest_date": "YYYY-MM-DD", "closure_evidence_ref": "number", "status": _STATUS}],
    },
}
DROPPED = "array<struct<path:string,value:string,reason:string>>"


def spark_type(node: Any) -> Y.DataType:
    """The type that holds a template node."""
    if isinstance(node, dict):
        return Y.StructType([Y.StructField(k, spark_type(v)) for k, v in node.items()])
    if isinstance(node, list):
        return Y.ArrayType(spark_type(node[0]))
    return {"number": Y.DoubleType(), "boolean": Y.BooleanType()}.get(node, Y.StringType())


def json_schema(node: Any) -> dict[str, Any]:
    """A strict JSON Schema of a template node: every key required, no others."""
    if isinstance(node, dict):
        return {"type": "object", "properties": {k: json_schema(v) for k, v in node.items()}, "required": [*node], "additionalProperties": False}
    if isinstance(node, list):
        return {"type": "array", "items": json_schema(node[0])}
    if node in ("string", "number", "boolean"):
        return {"type": [node, "null"]}
    if node == "YYYY-MM-DD":
        return {"anyOf": [{"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}, {"type": "null"}]}
    return {"enum": [*choices(node), None]}


def choices(leaf: str) -> list[str]:
    return [x.strip() for x in leaf.split("|")]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def coerce(v: Column, leaf: str) -> Column:
    """A variant as a leaf's type where nothing is lost by it; else null."""
    return T.let(F.struct(_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), lambda x: _coerce(x["kind"], x["text"], leaf))


def _coerce(kind: Column, text: Column, leaf: str) -> Column:
    is_text = kind == "STRING"
    if leaf == "string":
        return F.when(is_text | _is_number(kind), text)
    if leaf == "number":
        return F.when(_is_number(kind) | (is_text & text.rlike(r"^\s*-?\d+(\.\d+)?\s*$")), F.trim(text).try_cast("double"))
    low = F.lower(F.trim(text))
    if leaf == "boolean":
        return F.when((kind == "BOOLEAN") | is_text, F.when(low.isin("true", "false"), low == "true"))
    if leaf == "YYYY-MM-DD":
        return F.when(is_text, D.whole_date(text))
    return F.when(is_text, F.coalesce(*[F.when(low == x.lower(), F.lit(x)) for x in choices(leaf)]))


def _drop(path: Column, v: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.to_json(v).alias("value"), F.lit(reason).alias("reason")))


def corpus(value: Column, kind: Y.DataType) -> Column:
    """Everything that a record says, as one text: the names of its fields, whether they have a value or not, and the values, in order. What it says of itself
    (``_meta``, ``unmapped_content``) is left out."""
    if isinstance(kind, Y.StructType):
        said = [x for f in kind.fields if f.name not in ("_meta", "unmapped_content") for x in (F.lit(f.name.replace("_", " ")), corpus(value[f.name], f.dataType))]
        return F.concat_ws(" ", *said)
    if isinstance(kind, Y.ArrayType):
        return F.array_join(F.transform(value, lambda x: corpus(x, kind.elementType)), " ")
    if isinstance(kind, Y.FractionalType):
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def enforce(v: Column, node: Any = None, path: Column | None = None) -> Column:
    """(value, dropped): a variant in the template's shape, and an array of (path, value, reason) of what that shape can't hold.

    Unknown keys come first at each object, then its fields in the template's order. A list of scalars loses nulls and what can't be kept; a list of
    objects keeps its length. Every node is read once: its value and its log come from the same reading.
    """
    node, path = TEMPLATE if node is None else node, F.lit("") if path is None else path
    none = F.array().cast(DROPPED)
    stated = ~(v.isNull() | F.is_variant_null(v))

    def pair(value: Column, dropped: Column) -> Column:
        return F.struct(value.alias("value"), dropped.alias("dropped"))

    def read_object(x: Column) -> Column:
        dot = F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit(".")))
        parts = F.struct(*[enforce(F.try_element_at(x["fields"], F.lit(k)), sub, F.concat(dot, F.lit(k))).alias(k) for k, sub in node.items()])
        unknown = F.filter(F.map_entries(x["fields"]), lambda e: ~e["key"].isin([*node]))
        extra = F.transform(unknown, lambda e: F.struct(F.concat(dot, e["key"]).alias("path"), F.to_json(e["value"]).alias("value"), F.lit("not defined in the master schema").alias("reason")))
        wrong = F.when(stated & x["fields"].isNull(), _drop(path, v, "expected an object")).otherwise(none)
        return T.let(parts, lambda r: pair(F.struct(*[r[k]["value"].alias(k) for k in node]), F.concat(wrong, F.coalesce(extra, none), *[r[k]["dropped"] for k in node])))

    def read_list(x: Column) -> Column:
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        items = F.coalesce(F.transform(x["items"], lambda e, i: enforce(e, node[0], at(i))), F.array())
        wrong = F.when(stated & x["items"].isNull(), _drop(path, v, "expected a list")).otherwise(none)

        def both(r: Column) -> Column:
            values = F.transform(r, lambda y: y["value"])
            return pair(values if isinstance(node[0], dict) else F.filter(values, lambda y: y.isNotNull()), F.concat(wrong, F.flatten(F.transform(r, lambda y: y["dropped"]))))

        return T.let(items, both)

    def read_leaf(x: Column) -> Column:
        return T.let(_coerce(x["kind"], x["text"], node), lambda y: pair(y, F.when((x["kind"] != "VOID") & y.isNull(), _drop(path, v, f"not a valid {node!r}")).otherwise(none)))

    # What a variant is not casts to null, so objects and lists need no schema, which would be that of all they hold. Where a record has nothing, nothing is read.
    if isinstance(node, dict):
        read = T.let(F.struct(F.try_variant_get(v, "$", "map<string,variant>").alias("fields")), read_object)
    elif isinstance(node, list):
        read = T.let(F.struct(F.try_variant_get(v, "$", "array<variant>").alias("items")), read_list)
    else:
        return T.let(F.struct(_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), read_leaf)
    nothing = F.from_json(F.lit(json.dumps({"x": _nothing(node)})), Y.StructType([Y.StructField("x", spark_type(node))]))["x"]
    return F.when(v.isNull(), pair(nothing, none)).otherwise(read)


def enforce_typed(value: Column, node: Any = None, path: Column | None = None) -> Column:
    """``enforce`` of a value that has the template's types already: the same (value, dropped), without a text between. Only choices, dates and numbers that are
    none can fail; these and lists of objects are read once, the rest stays as it is."""
    node, path = TEMPLATE if node is None else node, F.lit("") if path is None else path
    none, reads = F.array().cast(DROPPED), {}

    def read(v: Column, n: Any, at: Column) -> Callable[[Column], Column]:
        """What a node becomes, once all that must be read is bound."""
        if isinstance(n, dict):
            dot = F.lit("") if at is path and path_is_root else F.concat(at, F.lit("."))
            parts = {k: read(v[k], sub, F.concat(dot, F.lit(k))) for k, sub in n.items()}
            return lambda r: F.struct(*[f(r).alias(k) for k, f in parts.items()])
        if n == ["string"]:
            return lambda r: F.coalesce(F.filter(v, lambda y: y.isNotNull()), F.array().cast("array<string>"))
        if n in ("string", "boolean"):
            return lambda r: v
        key = f"x{len(reads)}"
        if isinstance(n, list):
            reads[key] = F.transform(v, lambda e, i: enforce_typed(e, n[0], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))), None
            return lambda r: F.coalesce(F.transform(r[key], lambda y: y["value"]), F.array().cast(spark_type(n)))
        kept = F.when(F.abs(v) <= sys.float_info.max, v + F.lit(0.0)) if n == "number" else _coerce(F.lit("STRING"), v, n)
        reads[key] = kept, lambda r: F.when(v.isNotNull() & r[key].isNull(), _drop(at, v.cast("string").cast("variant"), f"not a valid {n!r}")).otherwise(none)
        return lambda r: r[key]

    path_is_root = node is TEMPLATE
    made = read(value, node, path)

    def both(r: Column) -> Column:
        logs = [F.coalesce(F.flatten(F.transform(r[k], lambda y: y["dropped"])), none) if log is None else log(r) for k, (_, log) in reads.items()]
        return F.struct(made(r).alias("value"), F.concat(none, *logs).alias("dropped"))

    return T.let(F.struct(*[c.alias(k) for k, (c, _) in reads.items()]), both) if reads else both(F.lit(None))


def _nothing(node: Any) -> Any:
    """A template node's value where there is none."""
    return {k: _nothing(v) for k, v in node.items()} if isinstance(node, dict) else [] if isinstance(node, list) else None


def missing_fields(record: Callable[[str], Column] | Column, node: Any = None, path: str = "") -> Column:
    """Paths of a record without a value, in the template's order; fields of list items are counted: ``a[*].b (1/2 missing)``."""
    parts = [p for k, sub in (TEMPLATE if node is None else node).items() for p in _missing(record[k], sub, f"{path}.{k}" if path else k)]
    return F.array_compact(F.array(*parts))


def _missing(value: Column, node: Any, path: str) -> list[Column]:
    if isinstance(node, dict):
        return [p for k, sub in node.items() for p in _missing(value[k], sub, f"{path}.{k}")]
    if isinstance(node, list):
        size = F.coalesce(F.when(value.isNotNull(), F.size(value)), F.lit(0))
        out = [F.when(size == 0, F.lit(f"{path} (empty)"))]
        if isinstance(node[0], dict):
            for k, sub in node[0].items():
                lacks = F.size(F.filter(value, _lacking(k, sub)))
                out.append(F.when((size > 0) & (lacks > 0), F.format_string(f"{path}[*].{k} (%d/%d missing)", lacks, size)))
        return out
    return [F.when(_lacks(value, node), F.lit(path))]


def _lacking(key: str, node: Any) -> Callable[[Column], Column]:
    return lambda x: _lacks(x[key], node)


def _lacks(value: Column, node: Any) -> Column:
    if isinstance(node, dict):
        return value.isNull()
    if isinstance(node, list):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if node not in ("number", "boolean") else value.isNull()


def violations(record: Column, most: int = 50) -> Column:
    """``path: message`` of choices and dates in a typed record that the template doesn't allow; empty after ``enforce``."""
    return F.slice(F.concat(*[p for k, sub in TEMPLATE.items() for p in _violations(record[k], sub, F.lit(k))]), 1, most)


def _violations(value: Column, node: Any, path: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    if isinstance(node, dict):
        return [p for k, sub in node.items() for p in _violations(value[k], sub, F.concat(path, F.lit(f".{k}")))]
    if isinstance(node, list):
        inner = lambda x, i: F.concat(none, *_violations(x, node[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return [F.coalesce(F.flatten(F.transform(value, inner)), none)]
    if node == "YYYY-MM-DD":
        wrong = value.isNotNull() & ~value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    elif "|" in node:
        wrong = value.isNotNull() & ~value.isin(choices(node))
    else:
        return []
    return [F.when(wrong, F.array(F.concat(path, F.lit(": "), F.to_json(F.struct(value.alias("value"))), F.lit(f" is not {node}")))).otherwise(none)]


def conform(text: Column) -> Column:
    """A JSON object's text with the template's missing keys added, as null, [] or {...}; extra keys and all values stay."""
    def fill(value: Any, node: Any) -> Any:
        if isinstance(node, dict):
            if value is None:
                return _nothing(node)
            return value if not isinstance(value, dict) else value | {k: fill(value[k], v) if k in value else _nothing(v) for k, v in node.items()}
        if isinstance(node, list):
            return [] if value is None else [fill(x, node[0]) for x in value] if isinstance(value, list) else value
        return value

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(fill(json.loads(t), TEMPLATE), ensure_ascii=False))

    return run(text)
