"""Queries over label texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridex import dims
from veridex.functions import patterns as P
from veridex.functions import text as T
from veridex.operators import labels
from veridex.plans.registry import query
from veridex.sources.views import view

V = ("label_text",)


def _labels(spark, sf_dir):
    return view(spark, sf_dir, "label_text")


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _ascii(pattern: str) -> str:
    """A pattern for an engine whose boundaries are ASCII already."""
    return pattern.replace(T.L, r"\b").replace(T.R, r"\b").replace("'", "''")


@query("SELECT doc_id, md5(replace(replace(replace(translate(text, chr(160) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212), ' ''''\"\"--'), chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl')) AS folded FROM documents")
def unicode_fold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.unicode_fold(F.col("text")).cast("binary")).alias("folded"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS tidy FROM documents")
def whitespace_tidy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.whitespace_tidy(F.col("text")).cast("binary")).alias("tidy"))


_WORDS = ", ".join(f"'{w}'" for w in dims.LABEL_VOCABULARY)
_FIXES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.LETTER_CONFUSIONS.items() if b.upper() in dims.LABEL_VOCABULARY)
_INS = _ascii(T.INS_REPAIR)
_CODED = f"""c AS (SELECT doc_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[CAST(i AS BIGINT)] || CASE WHEN i <= len(m) THEN 'INS ' || translate(m[CAST(i AS BIGINT)], '{dims.INS_DIGITS[0]}', '{dims.INS_DIGITS[1]}') ELSE '' END), '') AS text
  FROM (SELECT doc_id, string_split_regex(text, '{_INS}') AS b, regexp_extract_all(text, '{_INS}', 2) AS m FROM label_text))"""
_NORMAL = rf"""{_CODED}, n AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[CAST(i AS BIGINT)] || CASE WHEN i <= len(m) THEN f[CAST(i AS BIGINT)] ELSE '' END), ''), '(?m)[ \t]+$', '', 'g') AS text
  FROM (SELECT doc_id, b, m, list_transform(m, lambda t: CASE t {_FIXES} ELSE CASE WHEN t = upper(t) AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND list_contains([{_WORDS}], regexp_replace(translate(t, '01458', 'OIASB'), '[^A-Z]', '', 'g')) THEN translate(t, '01458', 'OIASB') ELSE t END END) AS f
    FROM (SELECT doc_id, string_split_regex(text, '[A-Za-z0-9][A-Za-z0-9.\-&+/'']*') AS b, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9.\-&+/'']*') AS m FROM c)))"""


@query(f"WITH {_NORMAL} SELECT doc_id, text FROM n", V)
def normalise_tokens(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.normalised(F.col("text")).alias("text"))


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in dims.INS_NAMES.items())
_CODES = f"x AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_ascii(T.INS_FIND)}', 1), lambda d: translate(d, 'OIl', '011'))) AS digits FROM n)"


@query(f"WITH {_NORMAL}, {_CODES} SELECT doc_id, 'INS ' || digits AS code, v.name FROM x LEFT JOIN (VALUES {_NAMES}) v(k, name) ON v.k = digits WHERE digits <> '000'", V)
def ins_codes(spark, sf_dir):
    c = _labels(spark, sf_dir).select("doc_id", F.explode(T.ins_codes(T.normalised(F.col("text")))).alias("c"))
    return c.select("doc_id", "c.code", "c.name")


@query(f"WITH {_NORMAL}, {_CODES} SELECT v.name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x LEFT JOIN (VALUES {_NAMES}) v(k, name) ON v.k = digits GROUP BY v.name", V)
def ins_reference_join(spark, sf_dir):
    """The same names by a broadcast join instead of a lookup."""
    names = spark.createDataFrame(list(dims.INS_NAMES.items()), "k string, name string")
    c = _labels(spark, sf_dir).select("doc_id", F.explode(T.ins_codes(T.normalised(F.col("text")))).alias("c")).select("doc_id", F.substring("c.code", 5, 3).alias("k"))
    return c.join(F.broadcast(names), "k", "left").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN 90 + p_partkey % 950 BETWEEN {a} AND {b - 1} THEN '{n}'" for a, b, n in dims.ADDITIVE_CLASSES) + " END AS class FROM part")
def additive_class(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.additive_class(90 + F.col("p_partkey") % 950).alias("class"))


_ALLERGEN = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{T.allergen_pattern(w, chr(92) + 'b', chr(92) + 'b')}') THEN '{n}' END" for n, w in sorted(dims.ALLERGENS.items()))


@query(f"SELECT doc_id, array_to_string(list_filter([{_ALLERGEN}], lambda x: x IS NOT NULL), ',') AS allergens FROM label_text", V)
def allergens_detected(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", F.array_join(T.allergens(F.lower("text")), ",").alias("allergens"))


_MARK = r"WHEN regexp_matches(f, '\bnon[ -]?veg(etarian)?\b|\bcontains (meat|chicken|beef|pork|fish|mutton)\b') THEN 'non_vegetarian' WHEN regexp_matches(f, '\b(contains egg|egg products?|mayo(nnaise)?|album[ei]n)\b') THEN 'egg_containing' WHEN regexp_matches(f, '\bveg(etarian)?\b') THEN 'vegetarian'"


@query(rf"SELECT doc_id, CASE {_MARK} ELSE 'unknown' END AS marker FROM (SELECT doc_id, regexp_replace(lower(text), '[\s|]+', ' ', 'g') AS f FROM label_text)", V)
def veg_marker(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.veg_marker(F.col("text")).alias("marker"))


# --- nutrition ---

_SKIPPED = " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in P.SKIP)
_ALIAS = ", ".join(f"({i}, '{a}', '{k}')" for i, (a, k) in enumerate(dims.NUTRIENTS))
_UNIT = " ".join(f"WHEN '{a}' THEN '{u}'" for a, u in dims.UNIT_ALIASES.items())
_LINES = rf"""l AS (SELECT doc_id, CAST(k AS INT) AS pos, trim(s[CAST(k + 1 AS BIGINT)]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM label_text)),
a AS (SELECT *, trim(regexp_replace(regexp_extract(line, '{T.LABEL}', 1), '[\s:.\-–—*]+$', '')) AS label FROM l WHERE line <> '' AND NOT ({_SKIPPED})),
b AS (SELECT *, substr(line, instr(line, label) + length(label)) AS rest, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '[;\s]+$', ''), '^[\s:.\-–—*,]+', ''), '\s+', ' ', 'g')) AS key FROM a),
u(ord, alias, nutrient) AS (VALUES {_ALIAS}),
m AS (SELECT b.*, coalesce((SELECT min(u.nutrient) FROM u WHERE u.alias = b.key), (SELECT arg_min(u.nutrient, u.ord) FROM u WHERE length(u.alias) >= 4 AND starts_with(b.key, u.alias))) AS nutrient FROM b),
p AS (SELECT *, try_cast(replace(regexp_extract(rest, '(?i){P.NUMBER}', 1), ',', '') AS DOUBLE) AS value, CASE lower(regexp_extract(rest, '(?i){P.NUMBER}', 2)) {_UNIT} END AS unit, regexp_matches(rest, '(?i){P.TRACE}') AS traced FROM m),
v AS (SELECT * FROM p WHERE nutrient IS NOT NULL AND (value IS NOT NULL OR traced))"""


@query(f"WITH {_LINES} SELECT doc_id, pos, nutrient, label, value, unit, value IS NULL AND traced AS trace FROM v", V)
def nutrition_values(spark, sf_dir):
    return labels.nutrition_values(_labels(spark, sf_dir)).select("doc_id", "pos", "nutrient", "label", "value", "unit", "trace")


@query(f"WITH {_LINES} SELECT doc_id, nutrient, arg_min(pos, pos) AS pos FROM v GROUP BY ALL", V)
def nutrition_dedupe(spark, sf_dir):
    return labels.first_values(labels.nutrition_values(_labels(spark, sf_dir))).select("doc_id", "nutrient", "pos")


@query(f"WITH {_LINES} SELECT doc_id, pos, line FROM p WHERE nutrient IS NULL OR (value IS NULL AND NOT traced)", V)
def undeciphered_lines(spark, sf_dir):
    return labels.undeciphered(_labels(spark, sf_dir)).select("doc_id", "pos", "line")


@query(f"WITH {_LINES} SELECT doc_id, pos, nutrient, CASE WHEN unit = 'kJ' THEN round(value / 4.184e0, 2) ELSE value END AS kcal FROM v WHERE nutrient = 'energy'", V)
def unit_conversion(spark, sf_dir):
    n = labels.nutrition_values(_labels(spark, sf_dir)).filter("nutrient = 'energy'")
    return n.select("doc_id", "pos", "nutrient", T.converted(F.col("value"), F.col("unit"), F.lit("kcal")).alias("kcal"))


# what follows is worked out by hand from how the view makes its labels: every expected value is written down


@query(
    rf"""WITH {_LINES}, d AS (SELECT doc_id, count(DISTINCT nutrient) AS n, bool_or(nutrient = 'energy') AS e FROM v GROUP BY doc_id), t AS (SELECT doc_id, regexp_matches(text, '(?i)per\s+\d+([.,]\d+)?\s*(g|gm|ml|serving)') AS b FROM label_text)
SELECT doc_id, CAST(d.n AS BIGINT) AS n, CAST(round(CAST(format('{{:.3f}}', CASE WHEN b THEN 1e0 ELSE 0.5e0 END * 0.2e0 + least(1e0, d.n / 8e0) * 0.3e0 + CASE WHEN e THEN 1e0 ELSE 0.4e0 END * 0.2e0 + 0.5e0 * 0.3e0) AS DOUBLE) * 1000) AS INT) AS confidence FROM d JOIN t USING (doc_id)""",
    V,
)
def nutrition_confidence(spark, sf_dir):
    return labels.nutrition_confidence(_labels(spark, sf_dir))


_NET = "CASE WHEN p_partkey % 6 = 0 THEN '4 x ' || p_size || ' g' ELSE p_size * 10 || ' g' END"


@query(f"SELECT p_partkey AS doc_id, {_NET} AS net_quantity FROM part")
def net_quantity(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.net_quantity(F.col("text")).alias("net_quantity"))


@query("SELECT p_partkey AS doc_id, (10 + p_partkey % 200 + 0.5)::DOUBLE AS amount FROM part")
def mrp(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.mrp_amount(F.col("text")).alias("amount"))


@query("SELECT p_partkey AS doc_id, CAST(10012051000000 + p_partkey AS VARCHAR) AS licence FROM part")
def fssai(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.fssai_licence(F.col("text")).alias("licence"))


@query("SELECT p_partkey AS doc_id, (1 + p_partkey % 24) || ' months' AS best_before FROM part")
def best_before(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.best_before(F.col("text")).alias("best_before"))


@query("SELECT p_partkey AS doc_id, 'India' AS country, 80 AS confidence FROM part")
def origin(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", T.origin(F.col("text")).alias("o")).select("doc_id", F.col("o.value").alias("country"), "o.confidence")


@query(
    """SELECT doc_id, 2 AS stage, 'ins_code' AS kind, 'INS62I' AS raw, 'INS 621' AS corrected, 0.95 AS confidence, instr(text, 'INS62I') - 1 AS start, instr(text, 'INS62I') + 5 AS end, 'ins_code_normalisation' AS reason FROM label_text
UNION ALL SELECT doc_id, 3, 'ocr_confusion', w.raw, w.made, 0.85, instr(text, w.raw) - 1, instr(text, w.raw) - 1 + length(w.raw), 'digit_letter_confusion_in_known_label_term' FROM label_text, (VALUES ('SUG4R', 'SUGAR'), ('P4LM', 'PALM'), ('0IL', 'OIL')) w(raw, made)
UNION ALL SELECT doc_id, 4, 'whitespace', '(multiple blank lines / trailing spaces)', '(collapsed)', 0.99, 0, length(text) + 1, 'whitespace_normalisation' FROM label_text WHERE doc_id % 6 <> 0""",
    V,
)
def correction_log(spark, sf_dir):
    return labels.corrections(_labels(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 6 = 0 THEN 0.875 ELSE 0.898 END AS confidence FROM part")
def correction_confidence(spark, sf_dir):
    """The mean of .95, three times .85 and, where blanks went, .99."""
    return _labels(spark, sf_dir).select("doc_id", T.edit_confidence(T.corrections(F.col("text"))).alias("confidence"))


#: Label lines as the view writes them, and how many come before the panel.
_PARTS = r"""p AS (SELECT p_partkey AS doc_id, 3 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS k, p_partkey % 4 = 0 AS warned,
  'SUG4R, Wheat Flour, INS ' || (300 + p_partkey % 40) || ', P4LM 0IL and Milk Solids (Soya Lecithin, INS 471), INS62I' AS list,
  'Energy ' || (50 + p_partkey % 400) || CASE WHEN p_partkey % 2 = 0 THEN ' kcal' ELSE ' kJ' END || chr(10) || 'Protein ' || (p_partkey % 30) || '.5 g' || chr(10) || 'Sodium ' || (p_partkey % 900) || ' mg' || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN 'Zzz qqq 1.2' ELSE 'Trans fat trace' END || chr(10) || 'Protein 9 g' AS panel,
  """ + _NET + r""" AS net, (10 + p_partkey % 200) AS rupees, CAST(10012051000000 + p_partkey AS VARCHAR) AS licence, (1 + p_partkey % 24) || ' months' AS best, p_brand, p_type, p_partkey % 3 = 0 AS meat FROM part)"""


@query(
    f"""WITH {_PARTS} SELECT doc_id, 'ingredients' AS kind, 'Ingredients: ' || list AS heading, list || CASE WHEN warned THEN chr(10) || 'May contain: nuts and sesame' ELSE '' END AS body, 2 AS start_line, k - 1 AS end_line FROM p
UNION ALL SELECT doc_id, 'nutrition', 'Nutrition Information (per 100 g)', 'Nutrition Information ()' || chr(10) || panel, k, k + 5 FROM p
UNION ALL SELECT doc_id, 'contains', 'May contain: nuts and sesame', 'May nuts and sesame', 3, 3 FROM p WHERE warned
UNION ALL SELECT doc_id, 'net_quantity', NULL, ': ' || net, k + 6, k + 6 FROM p
UNION ALL SELECT doc_id, 'mrp', NULL, 'Rs. ' || rupees || '.50', k + 7, k + 7 FROM p
UNION ALL SELECT doc_id, 'fssai', NULL, 'FSSAI . ' || licence || chr(10) || 'Best Before: ' || best || chr(10) || 'Made in India', k + 8, k + 10 FROM p
UNION ALL SELECT doc_id, 'best_before', NULL, ': ' || best || chr(10) || 'Made in India', k + 9, k + 10 FROM p"""
)
def sections(spark, sf_dir):
    return labels.found_sections(_labels(spark, sf_dir))


_ITEMS = f"""i(path, depth, raw, code, code_name, additive_class, allergens) AS (VALUES
  ('0', 0, 'Ingredients: SUGAR', NULL, NULL, NULL, ''), ('1', 0, 'Wheat Flour', NULL, NULL, NULL, 'gluten'), ('2', 0, '', '', '', 'antioxidant', ''), ('3', 0, 'PALM OIL', NULL, NULL, NULL, ''),
  ('4', 0, 'Milk Solids (Soya Lecithin, INS 471)', 'INS 471', 'mono and diglycerides', 'thickener / stabiliser / gelling agent', 'milk,soy'), ('4.0', 1, 'Soya Lecithin', NULL, NULL, NULL, 'soy'),
  ('4.1', 1, 'INS 471', 'INS 471', 'mono and diglycerides', 'thickener / stabiliser / gelling agent', ''), ('5', 0, 'INS 621', 'INS 621', 'monosodium glutamate', 'flavour enhancer', '')),
n(k, name) AS (VALUES {', '.join(f"({k}, '{v}')" for k, v in dims.INS_NAMES.items() if 300 <= int(k) < 340)}),
t AS (SELECT p_partkey AS doc_id, i.* REPLACE (CASE WHEN path = '2' THEN 'INS ' || (300 + p_partkey % 40) ELSE raw END AS raw, CASE WHEN path = '2' THEN 'INS ' || (300 + p_partkey % 40) ELSE code END AS code, CASE WHEN path = '2' THEN n.name ELSE code_name END AS code_name) FROM part CROSS JOIN i LEFT JOIN n ON n.k = 300 + p_partkey % 40)"""


@query(f"WITH {_ITEMS} SELECT doc_id, path, depth, raw, lower(raw) AS normalized, code, code_name, additive_class, allergens FROM t")
def ingredient_tree(spark, sf_dir):
    items = labels.ingredient_items(_labels(spark, sf_dir))
    return items.withColumns({"path": F.array_join(F.col("path").cast("array<string>"), "."), "allergens": F.array_join("allergens", ",")})


@query("SELECT p_partkey AS doc_id, 6 AS items, 3 AS with_codes, 0.8 AS confidence, 'derived' AS confidence_source FROM part")
def ingredient_confidence(spark, sf_dir):
    """Six items of which three have codes: .35 + .25 + 3/6 of .15 + half of .25."""
    return labels.ingredient_confidence(_labels(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT a.doc_id, a.path, count(*) - 1 AS below FROM t a JOIN t b ON a.doc_id = b.doc_id AND (b.path = a.path OR starts_with(b.path, a.path || '.')) GROUP BY ALL")
def ingredient_descendants(spark, sf_dir):
    """Items with the number of items below them, by the paths of the flat tree."""
    items = labels.ingredient_items(_labels(spark, sf_dir)).select("doc_id", "path")
    up = items.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    return up.groupBy("doc_id", "path").agg((F.count("*") - 1).alias("below")).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@query(f"WITH {_ITEMS} SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM t WHERE code IS NOT NULL GROUP BY doc_id")
def ingredient_codes(spark, sf_dir):
    """All codes of a label's tree, each once, sorted."""
    items = labels.ingredient_items(_labels(spark, sf_dir)).filter("code is not null")
    return items.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


@query(
    f"""WITH {_PARTS} SELECT doc_id, f.* FROM p, LATERAL (VALUES
  ('name', p_brand || ' ' || p_type, 0.45, 'derived', p_brand || ' ' || p_type), ('brand', substr(p_brand, 6) || ' ' || p_type, 0.75, 'derived', p_brand || ' ' || p_type), ('variant_or_flavour', NULL, NULL, 'unknown', NULL),
  ('net_quantity', net, 0.85, 'derived', 'Net Qty: ' || net), ('mrp', rupees || '.5 INR', 0.9, 'derived', 'Rs. ' || rupees || '.50'), ('fssai_license', licence, 0.92, 'derived', 'FSSAI . ' || licence),
  ('veg_marker', CASE WHEN meat THEN 'non_vegetarian' ELSE 'vegetarian' END, CASE WHEN meat THEN 0.9 ELSE 0.8 END, 'derived', CASE WHEN meat THEN 'non-veg' ELSE 'veg' END), ('manufacturer', NULL, NULL, 'unknown', NULL),
  ('best_before', best, 0.6, 'derived', best), ('country_of_origin', 'India', 0.8, 'derived', 'Made in India')) f(field, value, confidence, confidence_source, evidence)"""
)
def product_fields(spark, sf_dir):
    return labels.products(_labels(spark, sf_dir))


@query(
    """SELECT p_partkey AS doc_id, 'INS ' || (300 + p_partkey % 40) || ',INS 471,INS 621' AS ins_codes, CASE WHEN p_partkey % 4 = 0 THEN 'nuts,sesame' ELSE '' END AS declared,
  'fssai_license,veg_marker,mrp,net_quantity,country_of_origin' AS label_signals, '' AS elsewhere FROM part"""
)
def label_signals(spark, sf_dir):
    got = labels.signals(_labels(spark, sf_dir))
    return got.select("doc_id", *[F.array_join(c, ",").alias(c) for c in got.columns[1:]])


@query(
    f"""WITH {_PARTS} SELECT doc_id, '1' AS version, 6 + CASE WHEN warned THEN 1 ELSE 0 END AS sections, 8 AS ingredients, 'gluten,milk,soy' AS from_ingredients, CASE WHEN warned THEN 'nuts,sesame' ELSE '' END AS declared, CASE WHEN warned THEN 'May contain: nuts and sesame' END AS statement,
  'energy,protein,sodium' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ',trans_fat' END || ',protein' AS nutrients, net AS net_quantity, 'INS ' || (300 + doc_id % 40) || ',INS 471,INS 621' AS codes, '' AS warnings FROM p"""
)
def analysis_documents(spark, sf_dir):
    """The whole documents, read back from their JSON in part."""
    d = labels.documents(_labels(spark, sf_dir))
    schema = """schema_version string, sections array<struct<kind string>>, ingredients array<struct<path array<int>>>, allergens struct<from_ingredients array<string>, declared array<string>, cross_contamination array<string>>,
      nutrition array<struct<pos int, nutrient string>>, product struct<net_quantity struct<value string>>, signals struct<ins_codes array<string>>, warnings array<string>"""
    j = d.select("doc_id", F.from_json("document", schema).alias("d"))
    text = lambda c: F.array_join(c, ",")
    return j.select(
        "doc_id", F.col("d.schema_version").alias("version"), F.size("d.sections").alias("sections"), F.size("d.ingredients").alias("ingredients"), text("d.allergens.from_ingredients").alias("from_ingredients"), text("d.allergens.declared").alias("declared"),
        F.get("d.allergens.cross_contamination", 0).alias("statement"), text(F.transform("d.nutrition", lambda n: n["nutrient"])).alias("nutrients"), F.col("d.product.net_quantity.value").alias("net_quantity"), text("d.signals.ins_codes").alias("codes"), text("d.warnings").alias("warnings"),
    )


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS replies FROM conversations GROUP BY conv_id")
def conversation_counts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"))


@query("SELECT doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, CAST(k AS INT) AS pos, s[CAST(k + 1 AS BIGINT)] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM label_text)) WHERE contains(lower(line), 'in')) WHERE k = 1", V)
def first_matching_line(spark, sf_dir):
    lines = labels.lines(_labels(spark, sf_dir)).filter(F.lower("line").contains("in"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    return lines.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("doc_id", "pos", "line")
