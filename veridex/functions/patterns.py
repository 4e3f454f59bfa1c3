"""Patterns that printed labels are read with, and how they are put into expressions.

The patterns below are fixed values: results depend on every part of them. Their word boundaries are those of ASCII
words and letters match in both cases; `java` says so for Spark's engine, others do so by themselves or by a flag.
"""

from __future__ import annotations

import re

#: Spark's \w is that of ASCII, and is looked up at once; a class of ranges tries one after the other.
_LEFT, _RIGHT = r"(?<!\w)", r"(?!\w)"
_EITHER = rf"(?:(?<=\w){_RIGHT}|{_LEFT}(?=\w))"

# --- fixed values: product fields; the value is the first group ---
NET = r"\bnet\s*(?:qty\.?|quantity|weight|wt\.?|content|volume)\b[^0-9]{0,20}(\d+(?:[.,]\d+)?\s*(?:kg|kgs|g\b|gm|gms|ml\b|m\.?l|l\b|ltr|litre|liter|oz|mg|mcg|µg)|[0-9]+\s*(?:x|×)\s*[0-9]+\s*\w+)"
NET_LOOSE = r"\b(\d+(?:[.,]\d+)?\s*(?:kg|g|gm|gms|ml|ltr|litre|liter|oz))\b"
MRP = r"\b(?:m\.?r\.?p\.?|mrp|maximum\s+retail\s+price|price)\b\s*(?:[:\-–]?\s*(?:rs\.?|₹|inr|mrp)\s*[:\-–]?)?([0-9]+(?:[.,][0-9]{1,2})?)"
MRP_AMOUNT = r"(?:rs\.?|₹|inr)\s*[:\-–]?\s*([0-9]+(?:[.,][0-9]{1,2})?)"
FSSAI = r"\b(?:fssai|lic(?:en[cs]e)?\.?\s*no\.?|lic(?:en[cs]e)?\.?\s*number|central\s+lic(?:en[cs]e)\s*no)\b[^\n0-9]{0,20}(\d{14})"
FSSAI_LOOSE = r"\b(\d{14})\b"
BEST_BEFORE = r"\b(?:best\s+before|use\s+by|best\s+first|expiry|shelf\s*life)\b\s*[:\-–]?\s*([^\n|.]{2,60})"
ORIGIN = r"\b(?:made\s+in|produced\s+in|manufactured\s+in|origin|packed\s+in)\b\s*[:\-–]?\s*([a-z ]{3,40})"
COUNTRY = r"\b(?:india|bangladesh|pakistan|nepal|sri\s+lanka|united\s+kingdom|uae|united\s+arab\s+emirates|global|london)\b"
FLAVOUR = r"\b(?:flavou?r|variant)\b\s*[:\-–]?\s*([^\n|.]{2,40})"
MAKER = r"\b(?:manufactur(?:ed|er)|marketed|packed|processed)\s+by\b\s*[:\-–]?\s*([^\n|]{3,80})"
BRAND = r"\b(?:brand|branded\s+by|packed\s+by|marketed\s+by|produced\s+by)\b\s*[:\-–]?\s*([^\n:|\-–]{2,60})"

# --- fixed values: lines that are no product's name ---
LEGAL_NOISE = [
    r"\b(?:fssai|lic\.?\s*no|licence|license|batch|b\/?no|mfg|manufactured|packed|marketed|use\s+by|best\s+before|store|keep|refrigerat|copyright|all\s+rights|www\.|http|email|phone|toll|customer\s+care)\b",
    r"\b(?:co-?operative|limited|private|pvt\.?|ltd\.?|industries|enterprises|company|agro|industries)\b",
    r"^\s*[\d\s.,%+/()-]+$",
    r"\b(?:contains|ingredients|nutrition|allergen|coa|product|packed|net|mrp)\b",
    r"\b\d{6,}\b",
    r"\b(?:anand|india|bengaluru|mumbai|delhi|gujarat|kerala|maharashtra|tamil\s+nadu)\b",
]
NO_NAME_STARTS = r"^(?:ingredients?|nutrition|contains|allergen|veg|non-veg|store|mrp|net|fssai)"
NO_NAME_WORDS = r"\b(?:pvt|ltd|limited|inc|corp|company|industries|co-?operative)\b"

# --- fixed values: diet marks in order of precedence: mark, confidence, patterns over lower-cased text in one line ---
MARKERS = [
    ("non_vegetarian", 0.9, [r"\bnon[\s\-]?veg(?:etarian)?\b", r"\bnon[\s\-]?vegetarian\b", r"\bcontains\s+meat\b", r"\bcontains\s+(?:chicken|beef|pork|fish|mutton)\b"]),
    ("egg_containing", 0.7, [r"\bcontains\s+egg\b", r"\begg\s+products?\b", r"\bmayo\b", r"\bmayonnaise\b", r"\balbumen\b", r"\balbumin\b"]),
    ("vegetarian", 0.8, [r"\bveg(?:etarian)?\b", r"\bvegetarian\b", r"\bshudh\s+veg\b", r"\b100%\s*veg\b", r"\bmark\s+of\s+veg\b"]),
]

# --- fixed values: ingredients ---
CROSS_CONTAMINATION = r"(?:\n|[.;:]\s*|\s)(?:may\s+contain|sh\s*contain|traces?\s+of|processed\s+in\s+(?:a|the)\s+facility|manufactured\s+in\s+(?:a|the)\s+facility|allergen\s+declaration)\b\s*[:\-–]?"
INGREDIENT_HEADING = r"\b(?:ingredients?|composition|made\s+from|prepared\s+from)\b"
NUTRITION_HEADING = r"\bnutrition(?:al)?\b"

# --- fixed values: nutrition lines ---
SKIP = [r"\bnutrition(?:al)?\b", r"\bper\s+\d+\s*(?:g|ml|gm|serving|100\s*g|100\s*ml)\b", r"\*(?:approx|approximately)\b", r"^[\s|*\-–—]+$", r"\brda\b", r"\bextract\s+of\s+values?\b", r"\bpercent(?:age)?\s+daily\b", r"\bservings?\s+per\b"]
NUMBER = r"(\d+(?:[.,]\d+)?)\s*(kcal|kcal\.?|kj|g|gm|grams?|mg|mgs|milligrams?|µg|ug|mcg|%|iu)?"
PERCENT = r"(\d+(?:[.,]\d+)?)\s*%"
TRACE = r"\b(trace|tr\.|nil|negligible|not\s+detected)\b"
NUTRIENT_NAME_END = r"(?:\s*\(|\s*\d|\s*(?:trace|tr\.|nil|negligible|not\s+detected)\b|$)"
QUALIFIER = r"^(?:(?:of\s+which|including|incl\.?|contains?|approx\.?|approximately|\*|total\s+amount\s+of)\s+){1,3}"
BASIS = r"per\s+(\d+(?:[.,]\d+)?\s*(?:g|gm|ml|ml\b|serving|100\s*g|100\s*ml))"
SERVING = r"\b(?:serving\s+size|serves?\s+about|approx\.?\s*per)\b[:\s]*([0-9]+\s*(?:g|gm|ml|piece|cup|slice|tbsp|tsp)?)"

# --- fixed values: sections: kind, headings, what ends it, most lines ---
SECTIONS = [
    ("ingredients", [r"\bingredients?\b\s*[:\-–]?", r"\bingredient\s+list\b", r"\bcomposition\b\s*[:\-–]?", r"\bmade\s+from\b", r"\bingredients?\s+used\b", r"\bcontains\s+following\b", r"\bprepared\s+from\b"],
     [r"\bnutrition\b", r"\ballergen", r"\bcontains\b\s*[:\-]?\s*(allergen|milk|gluten|soy|soya|nut)", r"\bstorage\b", r"\bstore\s+in\b", r"\busage\b", r"\binstructions?\b", r"\bfor\s+best\b", r"\bmrp\b", r"\bnet\s+(qty|quantity|weight|content)\b", r"\bbest\s+before\b", r"\buse\s+by\b", r"\bmanufactur", r"\bfssai\b", r"\bclaim", r"\bmarketed\s+by\b", r"\bco-?operative\b"], 14),
    ("ingredients_continued", [r"\bingredients?\s*[:\-–]?\s*(cont(?:inued|d)?|part\s*ii)\b", r"\b\(?cont(?:inued|d)?\)?\s*[:\-–]"], [], 10),
    ("nutrition", [r"\bnutrition(?:al)?\s+(?:facts?|information|values?|panel|table)\b", r"\bnutritional\s+content\b", r"\bnutrition\b\s*[:\-–]", r"\bper\s+100\s*(?:g|ml|gm)\b"],
     [r"\bingredients?\b", r"\ballergen", r"\bstorage\b", r"\bstore\s+in\b", r"\bmrp\b", r"\bfssai\b", r"\bnet\s+(?:qty|quantity|weight|content)\b", r"\bbest\s+before\b", r"\bmanufactur", r"\bmarketed\s+by\b", r"\bclaim", r"\bfor\s+best\b"], 22),
    ("allergens", [r"\ballergens?\b", r"\ballergen\s+(?:information|warning|declaration)\b", r"\bdeclaration\s+of\s+allergens?\b"], [r"\bingredients?\b", r"\bnutrition", r"\bstorage\b", r"\bmrp\b", r"\bfssai\b"], 6),
    ("contains", [r"\bcontains?\b\s*[:\-–]?\s*(?:allergens?\b)?", r"\bmay\s+contain\b", r"\bsh\s*contain(?:s|ing)?\b", r"\bprocess(?:ed)?\s+(?:in|on)\b", r"\btraces?\s+of\b"], [r"\bnutrition", r"\bstorage\b", r"\bmrp\b", r"\bfssai\b"], 6),
    ("storage", [r"\bstorage\b", r"\bstore\s+in\b", r"\bstored\s+in\b", r"\bkeep\s+(?:in|under|coolly)\b"], [r"\bmrp\b", r"\bfssai\b", r"\bingredients?\b", r"\bnutrition"], 6),
    ("usage", [r"\b(?:usage|use|consumption)\s+(?:instructions?|guidelines?)\b", r"\bhow\s+to\s+use\b", r"\binstructions?\s+(?:for\s+use|on\s+use)\b", r"\bserving\s+size\b"], [r"\bmrp\b", r"\bfssai\b", r"\bingredients?\b", r"\bnutrition"], 6),
    ("manufacturer", [r"\bmanufactur(?:ed|er)\s+by\b", r"\bmarketed\s+by\b", r"\bpacked\s+by\b", r"\bprocessed\s+by\b", r"\b(?:f|p|m)\s*(?:no|da)\s*[:\-–]"], [r"\bmrp\b", r"\bfssai\b"], 8),
    ("fssai", [r"\bfssai\b", r"\blic(?:en[cs]e)?\.?\s*(?:no|number)\b", r"\bfo(?:od)?\s*lic(?:en[cs]e)?\b", r"\bcentral\s+licen[cs]e\s+no\b"], [], 3),
    ("mrp", [r"\bm\.?r\.?p\.?\b", r"\bmaximum\s+retail\s+price\b"], [r"\bfssai\b"], 4),
    ("net_quantity", [r"\bnet\s+(?:qty|quantity|weight|content|wt)\b", r"\bpacked\s+net\b", r"\bcontents?\s*[:\-–]\s*\d"], [r"\bmrp\b", r"\bfssai\b"], 3),
    ("best_before", [r"\bbest\s+before\b", r"\buse\s+by\b", r"\bbest\s+first\b", r"\bexpiry\b", r"\bshelf\s+life\b"], [r"\bmrp\b", r"\bfssai\b"], 3),
    ("claims", [r"\b(?:no|zero|100%|100\s*%)[\s-]?(?:added\s+)?(?:colou?r|preservative|sugar|fat|trans\s*fat|cholesterol)\b", r"\bno\s+added\b", r"\b(?:rich\s+in|source\s+of|high\s+protein|low\s+fat|multigrain|whole\s+wheat|organic|vegan|vegetarian)\b", r"\bclaim(?:s|ed)?\b"], [r"\bingredients?\b", r"\bnutrition"], 4),
]
#: Kinds whose heading is the declaration itself.
DECLARATIONS = ["fssai", "mrp", "net_quantity", "best_before"]


def java(pattern: str, fold: bool = True) -> str:
    """The pattern for Spark, with ASCII word boundaries whatever letters stand beside a word."""
    if re.search(r"\\\.\??(?:[|)]|\\b)", pattern) or r"\b\(" in pattern:  # what stands beside the boundary may be no letter
        out = re.sub(r"^\\b(?=[a-z]|\(\?:[a-z])", lambda m: _LEFT, pattern).replace(r"\b", _EITHER)
    else:
        out = re.sub(r"\\b(?=[A-Za-z0-9]|\\d|\(\?:[A-Za-z0-9]|\(\\d)", lambda m: _LEFT, pattern)
        out = out.replace(r"\b", _RIGHT)
    return ("(?i)" if fold else "") + out


def any_of(patterns: list[str], fold: bool = True) -> str:
    """A pattern that fits where one of these does; the boundary that most begin with is tried once for all."""
    made = [java(p, False) for p in patterns]
    inner = [p[len(_LEFT) :] for p in made if p.startswith(_LEFT)]
    rest = [f"(?:{p})" for p in made if not p.startswith(_LEFT)]
    return ("(?i)" if fold else "") + "|".join([*([f"{_LEFT}(?:{'|'.join(inner)})"] if inner else []), *rest])
