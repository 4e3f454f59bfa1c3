"""Product fields of a label: each field is the first of its attempts that finds something."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridex.functions import patterns as P
from veridex.functions.net import let
from veridex.functions.sections import trimmed

FIELDS = "name brand variant_or_flavour net_quantity mrp fssai_license veg_marker manufacturer best_before country_of_origin".split()
FIELD = "struct<field:string,value:string,confidence:double,confidence_source:string,evidence:string>"


def squeezed(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", " ")


def attempt(source: Column, pattern: str, sure: Column | float, change=trimmed) -> Column:
    """struct(value, confidence, evidence) of the pattern's first match; null without one."""
    value = change(F.regexp_extract(source, P.java(pattern), 1))
    sure = F.lit(sure).cast("double") if not isinstance(sure, Column) else sure
    return let(value, lambda v: F.when(v != "", F.struct(v.alias("value"), sure.alias("confidence"), trimmed(F.regexp_extract(source, P.java(pattern), 0)).alias("evidence"))))


def plain_number(digits: Column) -> Column:
    """Digits with an optional fraction without needless zeros; commas go."""
    n = F.regexp_replace(F.replace(digits, F.lit(",")), r"^0+(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _line(body: Column, least: int, most: int) -> Column:
    """The first line of a section's body as a value of its own, if it is that long."""
    line = trimmed(F.regexp_replace(F.get(F.split(trimmed(body), "\n"), 0), r"^[:\-–\s]+", ""))
    return let(line, lambda v: F.when(F.char_length(v).between(least, most), F.struct(v.alias("value"), F.lit(0.6).alias("confidence"), v.alias("evidence"))))


def _marker(text: Column) -> Column:
    def rules(flat: Column) -> Column:
        one = lambda name, sure, p: F.when(flat.rlike(P.java(p, False)), F.struct(F.lit(name).alias("value"), F.lit(sure).alias("confidence"), F.regexp_extract(flat, P.java(p, False), 0).alias("evidence")))
        return F.coalesce(*[one(name, sure, p) for name, sure, ps in P.MARKERS for p in ps])

    return let(F.regexp_replace(F.lower(text), r"[\s|]+", " "), rules)


def _name(lines: Column, brand: Column) -> Column:
    """The first plausible line that is neither legal text nor a heading; less sure from the fourth plausible line on."""
    from veridex.functions.text import ingredient_name

    plausible = F.filter(F.transform(lines, trimmed), lambda s: F.char_length(s).between(1, 60) & ~s.rlike(P.any_of(P.LEGAL_NOISE)))

    def named(n: Column) -> Column:
        return ~n.rlike(P.java(P.NO_NAME_STARTS, False)) & ~n.rlike(P.java(P.NO_NAME_WORDS, False)) & (F.size(F.split(n, " ")) <= 12) & n.rlike(r"\p{L}")

    def pick(all_: Column) -> Column:
        def told(best: Column) -> Column:
            same = ingredient_name(best) == ingredient_name(brand["value"])
            sure = F.when(F.array_position(all_, best) <= 3, 0.45).otherwise(0.35)
            return F.when(best.isNotNull() & ~F.coalesce(same, F.lit(False)), F.struct(best.alias("value"), sure.alias("confidence"), best.alias("evidence")))

        return let(F.get(F.filter(all_, lambda s: let(ingredient_name(s), named)), 0), told)  # or each use would judge all lines again

    return let(plausible, pick)


def product_fields(text: Column, lines: Column, body) -> Column:
    """array of FIELD for every one of FIELDS; body(kind) is the body of a section, null if there is none."""
    near = lambda kind: F.coalesce(body(kind), text)
    sure = lambda kind, inside, outside: F.when(body(kind).isNotNull(), inside).otherwise(outside)
    price = lambda v: let(plain_number(v), lambda n: F.when(n != "", F.concat(n, F.lit(" INR"))).otherwise(""))
    brand = attempt(text, P.BRAND, 0.75)
    flavour = attempt(text, P.FLAVOUR, 0.55)
    origin = attempt(text, P.ORIGIN, 0.4, lambda v: squeezed(trimmed(v)))
    country = let(origin, lambda o: F.when(o.isNotNull(), F.struct(o["value"].alias("value"), F.when(o["value"].rlike(P.java(P.COUNTRY)), 0.8).otherwise(0.4).alias("confidence"), o["evidence"].alias("evidence"))))
    maker_line = let(_line(body("manufacturer"), 4, 80), lambda m: F.when(m["value"].rlike(r"\p{L}"), m))
    found = {
        "name": _name(lines, brand),
        "brand": brand,
        "variant_or_flavour": let(flavour, lambda f: F.when((F.char_length(f["value"]) < 60) & ~f["value"].rlike(r"^[:\-–\s]*$"), f)),
        "net_quantity": F.coalesce(attempt(text, P.NET, 0.85, lambda v: trimmed(squeezed(v))), attempt(near("net_quantity"), P.NET_LOOSE, 0.6, lambda v: trimmed(squeezed(v)))),
        "mrp": F.coalesce(attempt(near("mrp"), P.MRP, sure("mrp", 0.9, 0.75), price), attempt(body("mrp"), P.MRP_AMOUNT, 0.9, price)),
        "fssai_license": F.coalesce(attempt(near("fssai"), P.FSSAI, sure("fssai", 0.92, 0.7)), attempt(body("fssai"), P.FSSAI_LOOSE, 0.5)),
        "veg_marker": _marker(text),
        "manufacturer": F.coalesce(attempt(near("manufacturer"), P.MAKER, 0.8), maker_line),
        "best_before": F.coalesce(attempt(near("best_before"), P.BEST_BEFORE, sure("best_before", 0.85, 0.6)), _line(body("best_before"), 3, 60)),
        "country_of_origin": country,
    }
    one = lambda name, f: let(f, lambda x: F.struct(F.lit(name).alias("field"), x["value"].alias("value"), x["confidence"].alias("confidence"), F.when(x.isNull(), "unknown").otherwise("derived").alias("confidence_source"), x["evidence"].alias("evidence")))
    return F.array(*[one(n, found[n]) for n in FIELDS]).cast(f"array<{FIELD}>")
