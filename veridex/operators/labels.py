"""Structured records from label texts (doc_id, text). Nothing is invented: what is not read stays null.

Every reading is worked out within one row, so a text is read once and never shuffled. Python finds sections and takes
nested parentheses apart; all else are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions import ingredients as I
from veridex.functions import patterns as P
from veridex.functions import product, sections
from veridex.functions import text as T
from veridex.functions.rates import fixed
from veridex.functions.sections import trimmed
from veridex.shipping import ship

PRODUCT_SECTIONS = ["manufacturer", "mrp", "net_quantity", "fssai", "best_before"]


def lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _listed(texts: DataFrame, rows: Column, known: str) -> DataFrame:
    """doc_id and the fields of every struct of an array; `known` is a field that is never null.

    The outer form, as Spark works an inner one's array out twice: once to drop rows whose array is empty.
    """
    return texts.select("doc_id", F.inline_outer(rows)).filter(F.col(known).isNotNull())


# --- nutrition ---


def nutrition_values(texts: DataFrame) -> DataFrame:
    """One row per nutrient line with its value, unit, canonical value and trace mark."""
    return _listed(texts, T.nutrition_values(F.col("text")), "pos")


def undeciphered(texts: DataFrame) -> DataFrame:
    rows = _listed(texts, T.nutrition_lines(F.col("text")), "pos")
    return rows.filter("nutrient is null or (value is null and not traced)").select("doc_id", "pos", "line")


def first_values(values: DataFrame) -> DataFrame:
    """The first reading of each nutrient of a document."""
    rest = [c for c in values.columns if c not in ("doc_id", "nutrient")]
    return values.groupBy("doc_id", "nutrient").agg(F.min_by(F.struct(*rest), "pos").alias("v")).select("doc_id", "nutrient", "v.*")


def nutrition_confidence(texts: DataFrame) -> DataFrame:
    """n and confidence (thousandths, without a reader's own score) of texts with a nutrient.

    Basis found .2 (half without one), nutrients up to eight .3, energy found .2 (.4 of it without), reader .3 at half.
    """
    basis = F.col("text").rlike(P.java(P.BASIS))
    names = F.array_distinct(F.transform(T.nutrition_values(F.col("text")), lambda v: v["nutrient"]))
    # through a generator, or the filter would read all lines a second time
    rows = texts.select("doc_id", F.inline(F.array(F.struct(basis.alias("b"), names.alias("names"))))).filter("size(names) > 0")
    n, energy = F.size("names"), F.array_contains("names", "energy")
    score = F.when(F.col("b"), 1.0).otherwise(0.5) * 0.2 + F.least(F.lit(1.0), n / 8.0) * 0.3 + F.when(energy, 1.0).otherwise(0.4) * 0.2 + F.lit(0.5 * 0.3)
    return rows.select("doc_id", n.cast("bigint").alias("n"), F.round(fixed(score) * 1000).cast("int").alias("confidence"))


def with_panel(read: DataFrame) -> DataFrame:
    """Adds panel: of a nutrition section its basis and serving size as printed, the first reading of each nutrient, the
    lines that nobody could read, and the confidence (thousandths, null without a value); null without the section.
    """
    read = read.withColumn("_section", whole(of_kind("nutrition")))
    first = lambda p, group: F.nullif(trimmed(F.regexp_extract("_section", P.java(p), group)), F.lit(""))
    # through a generator, or every use would read all lines again
    read = read.select("*", F.inline(F.array(F.struct(first(P.BASIS, 0).alias("_basis"), first(P.SERVING, 1).alias("_serving"), T.nutrition_lines(F.col("_section")).alias("_lines")))))

    def once(values: Column) -> Column:
        names = F.array_distinct(F.transform(values, lambda v: v["nutrient"]))
        return F.transform(names, lambda n: F.get(F.filter(values, lambda v: v["nutrient"] == n), 0))

    read_ = F.filter("_lines", lambda v: v["nutrient"].isNotNull() & (v["value"].isNotNull() | v["traced"]))
    lost = F.filter("_lines", lambda v: v["nutrient"].isNull() | (v["value"].isNull() & ~v["traced"]))
    n, energy = F.size("_values"), F.exists("_values", lambda v: v["nutrient"] == "energy")
    score = F.when(F.col("_basis").isNotNull(), 1.0).otherwise(0.5) * 0.2 + F.least(F.lit(1.0), n / 8.0) * 0.3 + F.when(energy, 1.0).otherwise(0.4) * 0.2 + F.lit(0.5 * 0.3)
    read = read.select("*", F.inline(F.array(F.struct(once(read_).alias("_values"), F.transform(lost, lambda v: v["line"]).alias("_lost")))))
    panel = F.struct(F.col("_basis").alias("basis"), F.col("_serving").alias("serving_size"), F.col("_values").alias("values"), F.col("_lost").alias("undeciphered_lines"), F.when(n > 0, F.round(fixed(score) * 1000).cast("int")).alias("confidence"))
    return read.withColumn("panel", F.when(F.col("_section").isNotNull(), panel)).drop("_section", "_basis", "_serving", "_lines", "_values", "_lost")


def panels(texts: DataFrame) -> DataFrame:
    """doc_id, basis, serving_size, values, undeciphered_lines, confidence of the texts that have a nutrition section."""
    ship(texts.sparkSession)
    return with_panel(repaired(texts)).filter("panel is not null").select("doc_id", "panel.*")


# --- repaired text and sections ---


def corrections(texts: DataFrame) -> DataFrame:
    """The edit log of the repair steps: kind, raw, corrected, confidence, start, end, reason; offsets are of the step's own text."""
    return _listed(texts, T.corrections(F.col("text")), "stage")


def folded_letters(texts: DataFrame) -> DataFrame:
    """Every typographic letter that the repair replaces: raw, corrected, start, end. The edit log has but the first of a text."""
    return _listed(texts, T.folded_letters(F.col("text")), "raw")


def found_sections(texts: DataFrame) -> DataFrame:
    """The first region of each kind: heading, body, first and last line."""
    ship(texts.sparkSession)
    return _listed(texts.select("doc_id", sections.sections(F.col("text")).alias("s")), F.col("s"), "kind")


def repaired(texts: DataFrame, also: list[str] = ()) -> DataFrame:
    """doc_id, the columns named in `also`, the repaired text, its lines and its sections by kind."""
    t = texts.select("doc_id", *also, T.normalised(F.coalesce("text", F.lit(""))).alias("normalized_text"))
    ship(texts.sparkSession)
    return t.select("*", sections.lines_of(F.col("normalized_text")).alias("lines"), sections.sections(F.col("normalized_text")).alias("sections"))


def of_kind(kind: str) -> Column:
    """The section of a kind; null if there is none."""
    return F.get(F.filter("sections", lambda s: s["kind"] == kind), 0)


def whole(section: Column) -> Column:
    """All lines of a section, its heading's too."""
    return sections.trimmed(F.array_join(F.slice("lines", section["start_line"] + 1, section["end_line"] - section["start_line"] + 1), "\n"))


# --- ingredients and product ---


def _with_list(read: DataFrame) -> DataFrame:
    """Adds the ingredient section, its text and where in it a statement of cross-contamination begins."""
    read = read.withColumn("ingredient_section", F.coalesce(of_kind("ingredients"), of_kind("ingredients_continued")))
    read = read.withColumn("_text", I.section_text(whole(F.col("ingredient_section"))))
    return read.withColumn("_start", I.statement_start(F.col("_text")))


def with_ingredients(read: DataFrame) -> DataFrame:
    """Adds the ingredient section, its items as a flat tree and a statement of cross-contamination."""
    ship(read.sparkSession)
    read = _with_list(read)
    read = read.withColumn("_nodes", I.split_items(I.listed(F.col("_text"), F.col("_start"))))
    read = read.withColumns({"statement": I.statement(F.col("_text"), F.col("_start")), "items": I.read_items(F.col("_nodes"))})
    return read.drop("_text", "_start", "_nodes")


def ingredient_rows(texts: DataFrame) -> DataFrame:
    """doc_id, path, raw, head, heads and error of the items of every text's ingredient list, by the table function."""
    ship(texts.sparkSession)
    return I.item_rows(_with_list(repaired(texts)).select("doc_id", I.listed(F.col("_text"), F.col("_start")).alias("list")))


def ingredient_items(texts: DataFrame) -> DataFrame:
    """Ingredients as rows of a flat tree: path holds the positions from the root, parents come before children."""
    rows = ingredient_rows(texts).filter("path is not null")
    return rows.select("doc_id", "path", (F.size("path") - 1).alias("depth"), "raw", *[c.alias(k) for k, c in I.item_fields(F.col("raw"), F.col("heads")).items()])


def ingredient_errors(texts: DataFrame) -> DataFrame:
    """doc_id and error of the texts whose ingredient list could not be read whole."""
    return ingredient_rows(texts).filter("error is not null").select("doc_id", "error")


def ingredient_confidence(texts: DataFrame) -> DataFrame:
    read = with_ingredients(repaired(texts))
    return read.select("doc_id", I.confidence(F.col("items"), F.col("ingredient_section.heading")).alias("c")).select("doc_id", "c.*")


def with_product(read: DataFrame) -> DataFrame:
    bodies = {k: of_kind(k)["body"] for k in PRODUCT_SECTIONS}
    read = read.withColumn("_bodies", F.struct(*[b.alias(k) for k, b in bodies.items()]))
    return read.withColumn("product", product.product_fields(F.col("normalized_text"), F.col("lines"), lambda k: F.col("_bodies")[k])).drop("_bodies")


def products(texts: DataFrame) -> DataFrame:
    """Product fields with confidence, source and evidence; one row per document and field."""
    return _listed(with_product(repaired(texts)), F.col("product"), "field")


# --- whole documents ---


def declared_allergens() -> Column:
    """Allergens of the allergen declaration, then those of a statement of contents, each once."""
    return I.declared_allergens(of_kind("allergens")["body"], of_kind("contains")["body"])


def label_codes() -> Column:
    """The additive codes of the repaired text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(T.ins_codes(F.col("normalized_text")), lambda c: c["code"])))


def label_signals() -> Column:
    """What an Indian retail label shows, in a fixed order."""
    shown = lambda f: F.exists("product", lambda p: (p["field"] == f) & p["value"].isNotNull())
    names = ["fssai_license", "veg_marker", "mrp", "net_quantity", "country_of_origin"]
    return F.array_compact(F.array(*[F.when(shown(n), n) for n in names], F.when(of_kind("claims").isNotNull(), "claims")))


#: Label signals that stand for a product field.
FIELD_SIGNALS = ["fssai_license", "veg_marker", "mrp", "net_quantity", "country_of_origin"]


def signals(texts: DataFrame) -> DataFrame:
    """ins_codes, declared allergens, label_signals and those of them that are no product field (elsewhere)."""
    read = with_product(repaired(texts)).select("doc_id", label_codes().alias("ins_codes"), declared_allergens().alias("declared"), label_signals().alias("label_signals"))
    return read.withColumn("elsewhere", F.array_except("label_signals", F.array(*[F.lit(s) for s in FIELD_SIGNALS])))


def documents(texts: DataFrame) -> DataFrame:
    """One nested document per text as JSON: repaired text, sections, ingredients, allergens, nutrition, product, signals, warnings."""
    read = with_product(with_ingredients(repaired(texts)))
    panel = of_kind("nutrition")
    read = read.withColumn("nutrition", F.when(panel.isNotNull(), T.nutrition_values(whole(panel))))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    warnings = F.array_compact(F.array(F.when(none("items"), "ingredient_list_not_found"), F.when(panel.isNotNull() & none("nutrition"), "nutrition_section_found_but_unreadable")))
    by_items = F.array_sort(F.array_distinct(F.flatten(F.transform("items", lambda i: i["allergens"]))))
    fields = F.map_from_entries(F.transform("product", lambda p: F.struct(p["field"], F.struct(*[p[c].alias(c) for c in ("value", "confidence", "confidence_source", "evidence")]))))
    document = F.struct(
        F.lit("1").alias("schema_version"), "normalized_text", "sections", F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ("path", "normalized", "code", "allergens")])).alias("ingredients"),
        F.struct(by_items.alias("from_ingredients"), declared_allergens().alias("declared"), F.array_compact(F.array("statement")).alias("cross_contamination"), of_kind("allergens").isNotNull().alias("declared_in_section")).alias("allergens"),
        "nutrition", fields.alias("product"), F.struct(label_codes().alias("ins_codes"), label_signals().alias("label_signals")).alias("signals"), warnings.alias("warnings"),
    )
    return read.select("doc_id", F.to_json(document).alias("document"))
