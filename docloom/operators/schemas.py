"""Schemas of answers and their validation.

A ``SchemaSpec`` is built in (invoice, receipt, tables) or made from a JSON
Schema text; it validates decoded answers field by field, strips unknown
fields, and reports every error with its path.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.operators.nested import _LINE, _LINE_TEXT, decode_answer

_EMAIL = re.compile(r"[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}")


@dataclass(frozen=True)
class Type:
    """kind: string, number, integer, boolean, any, object, array, map, email, unit (number in [0, 1]) or cell."""

    kind: str
    fields: dict = field(default_factory=dict)
    item: Type | None = None
    nullable: bool = True
    optional: bool = True

    def check(self, v, path: str, errors: list[tuple[str, str]]):
        """The value by this type, unknown fields stripped; errors are appended."""
        if v is None:
            if not self.nullable and self.kind != "any":
                errors.append((path, "expected " + self.kind + ", got null"))
            return None
        k = self.kind
        num = isinstance(v, (int, float)) and not isinstance(v, bool)
        ok = (
            k == "any"
            or k == "string" and isinstance(v, str)
            or k == "email" and isinstance(v, str) and bool(_EMAIL.fullmatch(v))
            or k == "number" and num
            or k == "integer" and num and float(v).is_integer()
            or k == "unit" and num and 0 <= v <= 1
            or k == "boolean" and isinstance(v, bool)
            or k == "cell" and (num or isinstance(v, str))
            or k == "array" and isinstance(v, list)
            or k in ("object", "map") and isinstance(v, dict)
        )
        if not ok:
            errors.append((path, f"expected {k}, got {type(v).__name__}"))
            return None
        if k == "array":
            return [self.item.check(x, f"{path}[{i}]", errors) for i, x in enumerate(v)]
        if k == "map":
            return {n: self.item.check(x, f"{path}.{n}" if path else n, errors) for n, x in v.items()}
        if k == "object":
            out = {}
            for n, t in self.fields.items():
                p = f"{path}.{n}" if path else n
                if n in v:
                    out[n] = t.check(v[n], p, errors)
                elif not t.optional:
                    errors.append((p, "required"))
            return out
        return v

    def leaves(self, path: str = "") -> list[str]:
        """Dotted paths of all leaves."""
        if self.kind == "object" and self.fields:
            return [x for n, t in self.fields.items() for x in t.leaves(f"{path}.{n}" if path else n)]
        if self.kind in ("array", "map") and self.item:
            return self.item.leaves(path + ("[]" if self.kind == "array" else ".*"))
        return [path]


def _obj(optional: bool = True, nullable: bool = True, **fields: Type) -> Type:
    return Type("object", fields, nullable=nullable, optional=optional)


def _all(kind: str, names: str) -> dict[str, Type]:
    return {n: Type(kind) for n in names.split()}


def _list(item: Type, **kw) -> Type:
    return Type("array", item=item, **kw)


# fixed values: the fields of the built-in schemas
_ADDRESS = _obj(**_all("string", "street city postal_code country"))
_CONTACT = _obj(**_all("string", "name company_name"), address=_ADDRESS, phone=Type("string"), email=Type("email"), **_all("string", "website vat_number tax_id"))
_TOTALS = _obj(**_all("number", "subtotal discount_total tax_total shipping_cost total_amount amount_paid balance_due total_ht total_tva total_ttc montant_ht montant_tva montant_ttc"), currency=Type("string"))
_ITEM = _obj(**{n: Type("string" if n in _LINE_TEXT else "number") for n in _LINE})
_SECTION_ITEM = _obj(**{n: Type("number", nullable=False, optional=False) for n in "quantite prix_unitaire montant_ht taux_tva montant_tva montant_ttc".split()})
_SECTION = _obj(items=Type("map", item=_SECTION_ITEM), sous_total=_TOTALS)
_PAGE_TABLE = _obj(billed_services=_list(_ITEM), totals=_TOTALS, sections_detaillees=Type("map", item=_SECTION), total=_TOTALS, reference=Type("string"), exercice=Type("string"), montant_ttc=Type("number"), currency=Type("string"), raw_data=Type("map", item=Type("any")))
_PAGE = _obj(page=Type("number", nullable=False, optional=False), page_tables=_list(_PAGE_TABLE, nullable=False, optional=False))
_META = _obj(nullable=False, confidence_score=Type("unit", optional=False), fields_found=Type("integer", optional=False), fields_empty=Type("integer", optional=False), processing_notes=_list(Type("string")))


def _strict(t: Type) -> Type:
    return Type(t.kind, t.fields, t.item, nullable=False)


INVOICE = _obj(
    nullable=False,
    document_info=_obj(nullable=False, **_all("string", "document_type language currency"), total_pages=Type("integer")),
    invoice_details=_obj(nullable=False, **_all("string", "invoice_number invoice_date due_date purchase_order reference_number")),
    seller_info=_strict(_CONTACT),
    buyer_info=_strict(_CONTACT),
    line_items=_list(_ITEM),
    financial_totals=_strict(_TOTALS),
    payment_info=_obj(nullable=False, **_all("string", "payment_terms payment_method payment_due_date bank_details iban swift_code")),
    pages=_list(_PAGE),
    extraction_metadata=_META,
)
RECEIPT = _obj(nullable=False, **_all("string", "merchant_name transaction_date"), total_amount=Type("number"), **_all("string", "payment_method currency"), items=_list(_obj(name=Type("string"), **_all("number", "price quantity total"))))
TABLES = _obj(
    nullable=False,
    detected_tables=_list(_obj(**_all("string", "table_name table_type"), headers=_list(Type("string")), rows=_list(_list(Type("cell"))), summary=Type("string"))),
    extraction_metadata=_obj(tables_found=Type("integer"), confidence_score=Type("unit")),
)
SCHEMAS = {"comprehensive_invoice": INVOICE, "comprehensive": INVOICE, "invoice": INVOICE, "basic_receipt": RECEIPT, "receipt": RECEIPT, "tables_only": TABLES, "tables": TABLES}
SHORTHAND = {"int": "integer", "str": "string", "float": "number"}


def _convert(js: dict, required: bool) -> Type:
    kw = {"optional": not required, "nullable": False}
    t = js.get("type") if isinstance(js, dict) else None
    if isinstance(t, list):
        some = [x for x in t if x != "null"]
        # nested items and properties of a nullable type are not followed
        return Type(_SIMPLE.get(some[0], "any") if some and "null" in t else "any", optional=not required, nullable=True, item=Type("any"))
    if isinstance(t, str) and t.endswith(" or null"):
        return Type(SHORTHAND.get(t[:-8], "any"), optional=not required)
    t = SHORTHAND.get(t, t)
    if t == "array":
        return Type("array", item=_convert(js["items"], True) if isinstance(js.get("items"), dict) else Type("any"), **kw)
    if t == "object":
        props = js.get("properties") or {}
        return Type("object", {n: _convert(p, True) for n, p in props.items()}, **kw)
    return Type(_SIMPLE.get(t, "any"), **kw) if t in _SIMPLE else Type("any", optional=not required)


_SIMPLE = {"string": "string", "number": "number", "integer": "integer", "boolean": "boolean", "array": "array", "object": "object"}


@lru_cache(maxsize=1000)
def from_json(text: str) -> Type:
    """A JSON Schema text as a type. All listed properties are required;
    a top level without properties takes anything."""
    try:
        js = json.loads(text)
    except ValueError as e:
        raise ValueError("Invalid JSON schema") from e
    if isinstance(js, dict) and js.get("type") == "object" and isinstance(js.get("properties"), dict):
        return _convert(js, True)
    return Type("any")


def validate_answers(df: DataFrame, schema: Type | None = None, mode: str = "PERMISSIVE", id_col: str = "run_id", schema_col: str = "schema_name", data_col: str = "data") -> DataFrame:
    """(id, schema_used, success, data, errors): every row stays; rejected
    answers have null data and their errors. FAILFAST raises instead. A null or
    broken answer is rejected with one error at the root."""

    def fn(ids, names, answers):
        out = {id_col: ids, "schema_used": [], "success": [], "data": [], "errors": []}
        for name, a in zip(names, answers):
            spec = schema or SCHEMAS.get((name or "").strip().lower(), INVOICE)
            errors: list[tuple[str, str]] = []
            obj = decode_answer(a) if schema is None or schema.kind == "object" else _any_json(a)
            good = spec.check(obj, "", errors) if obj is not None else errors.append(("", "no JSON answer"))
            if errors and mode == "FAILFAST":
                raise ValueError(f"{errors[0][0] or 'answer'}: {errors[0][1]}")
            out["schema_used"].append("custom" if schema else name or "comprehensive")
            out["success"].append(not errors)
            out["data"].append(None if errors else json.dumps(good, ensure_ascii=False))
            out["errors"].append([{"path": p, "message": m} for p, m in errors])
        return out

    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col), F.col(schema_col), F.col(data_col)).dropDuplicates([id_col])
    return map_columns(src, fn, f"{id_col} {kind}, schema_used string, success boolean, data string, errors array<struct<path:string,message:string>>")


def _any_json(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def json_valid(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, is_json): strict validity, trailing text and NaN rejected; null text gives false."""

    def ok(t):
        try:
            json.loads(t, parse_constant=_reject)
            return True
        except (ValueError, TypeError, RecursionError):
            return False

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), lambda ids, ts: {id_col: ids, "is_json": [ok(t) for t in ts]}, f"{id_col} {kind}, is_json boolean")


def _reject(name: str):
    raise ValueError(name)


def json_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, key): the keys of each JSON text, arrays merged, in order of first sight."""

    def keys(v, seen):
        if isinstance(v, dict):
            for k, x in v.items():
                seen.setdefault(k)
                keys(x, seen)
        elif isinstance(v, list):
            for x in v:
                keys(x, seen)
        return seen

    def fn(ids, texts):
        rows = [(i, n, k) for i, t in zip(ids, texts) for n, k in enumerate(keys(_any_json(t), {}))]
        return dict(zip((id_col, "position", "key"), map(list, zip(*rows) if rows else [()] * 3)))

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), fn, f"{id_col} {kind}, position int, key string")
