"""Fixed values that results depend on. Small enough to broadcast or to compile into expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from math import log2

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: formats ---
FORMATS = ["EAN-13", "EAN-8", "UPC-A", "UPC-E", "Code 128", "Code 39", "Code 93", "ITF", "Codabar", "QR Code", "Data Matrix", "PDF417", "Aztec", "UNKNOWN"]
RETAIL_FORMATS = ["EAN-13", "EAN-8", "UPC-A", "UPC-E"]
TWO_D_FORMATS = ["QR Code", "Data Matrix", "Aztec", "PDF417"]
FUSION_2D_FORMATS = ["QR Code", "Data Matrix", "Aztec"]
NUMERIC_FORMATS = ["Code 128", "Code 39", "Code 93", "ITF"]
FORMAT_PRIOR = {
    "EAN-13": 1.0, "EAN-8": 0.9, "UPC-A": 0.85, "UPC-E": 0.7, "Code 128": 0.8, "Code 39": 0.55, "Code 93": 0.45,
    "ITF": 0.35, "Codabar": 0.25, "QR Code": 0.5, "Data Matrix": 0.35, "PDF417": 0.35, "Aztec": 0.3, "UNKNOWN": 0.1,
}
FORMAT_ALIASES = {
    "EAN8": "EAN-8", "EAN13": "EAN-13", "UPCA": "UPC-A", "UPCE": "UPC-E", "Code39": "Code 39", "Code93": "Code 93", "Code128": "Code 128",
    "ITF": "ITF", "Codabar": "Codabar", "QRCode": "QR Code", "DataMatrix": "Data Matrix", "PDF417": "PDF417", "Aztec": "Aztec",
    "MicroQRCode": "QR Code", "rMQRCode": "QR Code", "MaxiCode": "UNKNOWN",
    "ZBAR_EAN8": "EAN-8", "ZBAR_EAN13": "EAN-13", "ZBAR_UPCA": "UPC-A", "ZBAR_UPCE": "UPC-E", "ZBAR_CODE39": "Code 39", "ZBAR_CODE93": "Code 93",
    "ZBAR_CODE128": "Code 128", "ZBAR_I25": "ITF", "ZBAR_CODABAR": "Codabar", "ZBAR_QRCODE": "QR Code", "ZBAR_DATAMATRIX": "Data Matrix",
    "ZBAR_PDF417": "PDF417", "EAN-8": "EAN-8", "EAN-13": "EAN-13", "UPC-A": "UPC-A", "UPC-E": "UPC-E", "CODE-39": "Code 39",
    "CODE-128": "Code 128", "I25": "ITF", "QR-Code": "QR Code",
}

# --- fixed values: fusion ---
AGREEMENT = {1: 0.45, 2: 0.8, 3: 1.0}
STRUCTURAL = {"gtin_valid": 1.0, "gtin_invalid": 0.05, "other_valid": 0.8, "other_invalid": 0.2}
WEIGHTS = {"agreement": 0.35, "consistency": 0.25, "structural": 0.25, "format_prior": 0.12, "engine": 0.03}
RELATIVE_CUTOFF, STOP_CONFIDENCE, STOP_AGREEMENT, MAX_RESULTS = 0.6, 0.85, 2, 5

# --- fixed values: label words ---
LABEL_VOCABULARY = """SUGAR SALT WHEAT FLOUR MAIDA REFINED PALM OIL OILS GHEE MILK SOLIDS POWDER CREAM BUTTER CHEESE YOGURT CURD PANEER
MONOSODIUM GLUTAMATE CITRIC ACID BENZOATE SORBATE PROPIONATE GLYCERIN MALT DEXTRIN STARCH VITAMIN MINERALS FLAVOUR FLAVOURING EMULSIFIER
STABILIZER STABILISER PRESERVATIVE COLOUR COLOR SWEETENER THICKENER ANTIOXIDANT ACIDULANT BINDER MONO DIGLYCERIDES LECITHIN SOYA SOY MAIZE
CORN RICE CHICORY INULIN OLIGOSACCHARIDE TOCOPHEROL ASCORBIC PHOSPHORIC GUAR GUM CARRAGEENAN XANTHAN COCOA VANILLA CHOCOLATE TOMATO ONION
GARLIC SPICE SPICES RED PEPPER PAPRIKA TURMERIC CORIANDER CUMIN BLACK GINGER MUSTARD WATER SODA CARBONATED ACIDULANTS PRESERVATIVES NO ADDED
FLAVOURS CONTAINS ALLERGENS INGREDIENTS""".split()
LETTER_CONFUSIONS = {"QIL": "OIL", "Qil": "Oil", "Qll": "OIL", "QII": "OIL", "GHiE": "GHEE", "GHIE": "GHEE", "Ghie": "Ghee", "Sodiurn": "Sodium", "S0dium": "Sodium"}
TYPOGRAPHY = {"\u00a0": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}
DIGIT_TO_LETTER = ("01458", "OIASB")
INS_DIGITS = ("OoIliSsB", "00111558")
INS_NAMES = {
    "100": "sorbitol", "101": "sorbitol", "110": "sorbitol", "200": "sorbic acid", "202": "potassium sorbate", "210": "sodium benzoate",
    "211": "sodium benzoate", "212": "potassium benzoate", "215": "methyl ethyl ketoxime", "220": "sulphur dioxide", "221": "sodium metabisulphite",
    "222": "sodium bisulphite", "223": "calcium disodium edta", "224": "calcium disodium edta", "226": "potassium sorbate", "300": "ascorbic acid",
    "301": "ascorbic acid", "302": "ascorbic acid", "303": "ascorbic acid", "320": "tocopherols", "321": "tocopherols", "322": "lecithins",
    "325": "lactitol", "330": "citric acid", "331": "sodium citrates", "332": "sodium citrates", "333": "sodium citrates", "334": "sodium citrates",
    "335": "sodium citrates", "336": "potassium sorbate", "337": "sodium cetyl phosphate", "338": "calcium disodium edta", "339": "sodium stearoyl lactylate",
    "400": "calcium alginate", "401": "sodium alginate", "402": "calcium alginate", "404": "carrageenan", "405": "locust bean gum", "406": "locust bean gum",
    "407": "carrageenan", "410": "carob bean gum", "411": "guar gum", "412": "guar gum", "413": "gum arabic", "414": "gum arabic", "415": "xanthan gum",
    "416": "locust bean gum", "417": "tara gum", "440": "pectins", "441": "gelatin", "442": "cellulose", "443": "lactose", "444": "sorbitol", "445": "glycerol",
    "450": "lecithins", "451": "sorbitol", "452": "sorbitol", "466": "sodium carboxymethylcellulose", "471": "mono and diglycerides", "472": "sorbitol",
    "473": "sugar esters", "475": "sorbitol", "476": "polyglycerol polyricinoleate", "477": "sorbitol", "481": "sorbitol", "500": "sodium carbonates",
    "501": "sodium citrates", "503": "sodium nitrite", "504": "sodium nitrite", "508": "sodium phosphates", "510": "sodium nitrite", "511": "sodium nitrite",
    "520": "sodium aluminium phosphate", "522": "sodium aluminium phosphate", "621": "monosodium glutamate", "622": "monosodium glutamate",
    "623": "monosodium glutamate", "624": "monosodium glutamate", "625": "monosodium glutamate", "626": "monosodium glutamate", "640": "glycine",
    "641": "glycine", "900": "beeswax", "901": "beeswax", "902": "beeswax", "903": "carnauba wax", "904": "shellac", "905": "shellac", "906": "shellac",
    "950": "acesulfame potassium", "951": "aspartame", "952": "cyclamate", "953": "isomalt", "955": "sucralose", "956": "saccharin", "957": "thaumatin",
    "960": "steviol glycosides", "961": "neotame", "962": "salt", "999": "quillaia extract",
}
ADDITIVE_CLASSES = [
    (100, 200, "humectant"), (200, 300, "preservative"), (300, 400, "antioxidant"), (400, 500, "thickener / stabiliser / gelling agent"),
    (500, 600, "acidity regulator / raising agent"), (600, 700, "flavour enhancer"), (900, 1000, "flavouring / sweetener"),
]
#: Allergen to the words that declare it; a space stands for any white space, each word is bounded on both sides.
ALLERGENS = {
    "milk": ["milk", "dairy", "whey", "casein", "caseinate", "lactose"],
    "gluten": ["gluten", "wheat", "maida", "barley", "rye", "malt", "sevi", "bulgur"],
    "soy": ["soy", "soya", "soybean"],
    "nuts": ["almond", "cashew", "walnut", "pecan", "pistachio", "hazelnut", "brazil nut", "macadamia", "chestnut", "nut", "nuts"],
    "peanuts": ["peanut", "groundnut", "ground nut", "arachis"],
    "egg": ["egg", "albumen", "albumin", "mayo", "mayonnaise", "ovalbumin"],
    "fish": ["fish", "anchovy", "anchovies", "tuna", "salmon", "seal oil", "cod", "sardine"],
    "crustaceans": ["crustacean", "shrimp", "prawn", "crab", "lobster", "crayfish"],
    "sesame": ["sesame", "tilh", "sesamum"],
    "mustard": ["mustard", "rai", "sarson"],
    "celery": ["celery"],
    "lupin": ["lupin"],
    "molluscs": ["mollusc", "snail", "shellfish", "clam", "mussel", "cuttlefish"],
}
#: Of these, words that may go on after the last letter.
OPEN_ENDED = ["mollusc"]

# --- fixed values: nutrients, in order of precedence: label, key ---
NUTRIENTS = [
    ("energy", "energy"), ("energy from fat", "energy_from_fat"), ("calories", "energy"), ("total fat", "total_fat"), ("fat", "total_fat"),
    ("saturated fat", "saturated_fat"), ("trans fat", "trans_fat"), ("trans-fat", "trans_fat"), ("trans fatty acid", "trans_fat"),
    ("mono-unsaturated fatty acids", "mono_unsaturated_fatty_acids"), ("poly-unsaturated fatty acids", "poly_unsaturated_fatty_acids"),
    ("cholesterol", "cholesterol"), ("protein", "protein"), ("total carbohydrate", "total_carbohydrate"), ("carbohydrate", "total_carbohydrate"),
    ("carbohydrate - total", "total_carbohydrate"), ("sugars", "sugars"), ("total sugars", "sugars"), ("added sugars", "added_sugars"),
    ("sucrose", "sucrose"), ("fructose", "fructose"), ("glucose", "glucose"), ("galactose", "galactose"), ("lactose", "lactose"), ("maltose", "maltose"),
    ("fibre", "dietary_fibre"), ("fiber", "dietary_fibre"), ("dietary fibre", "dietary_fibre"), ("dietary fiber", "dietary_fibre"),
    ("soluble fibre", "soluble_fibre"), ("insoluble fibre", "insoluble_fibre"), ("sodium", "sodium"), ("total sodium", "sodium"), ("salt", "salt"),
    ("total salt", "salt"), ("calcium", "calcium"), ("iron", "iron"), ("phosphorus", "phosphorus"), ("magnesium", "magnesium"), ("zinc", "zinc"),
    ("iodine", "iodine"), ("selenium", "selenium"), ("potassium", "potassium"), ("vitamin a", "vitamin_a"), ("vitamin c", "vitamin_c"),
    ("vitamin d", "vitamin_d"), ("vitamin e", "vitamin_e"), ("vitamin k", "vitamin_k"), ("vitamin b1", "vitamin_b1"), ("vitamin b2", "vitamin_b2"),
    ("vitamin b3", "vitamin_b3"), ("vitamin b6", "vitamin_b6"), ("vitamin b9", "vitamin_b9"), ("folic acid: ", "folic_acid"), ("folic acid", "folic_acid"),
    ("vitamin b12", "vitamin_b12"), ("niacin", "niacin"), ("riboflavin", "riboflavin"), ("thiamine", "thiamine"), ("biotin", "biotin"),
    ("choline", "choline"), ("taurine", "taurine"),
]
KCAL_NUTRIENTS = ["energy", "energy_from_fat"]
MILLIGRAM_NUTRIENTS = "cholesterol sodium salt calcium iron phosphorus magnesium zinc potassium vitamin_c vitamin_e vitamin_b1 vitamin_b2 vitamin_b3 vitamin_b6 niacin riboflavin thiamine choline taurine".split()
MICROGRAM_NUTRIENTS = "iodine selenium vitamin_a vitamin_d vitamin_k vitamin_b9 folic_acid vitamin_b12 biotin".split()
UNIT_ALIASES = {"g": "g", "gm": "g", "grams": "g", "gram": "g", "mg": "mg", "mgs": "mg", "milligram": "mg", "µg": "µg", "ug": "µg", "mcg": "mcg", "kcal": "kcal", "kcal.": "kcal", "cal": "kcal", "calories": "kcal", "kj": "kJ", "%": "%", "iu": "IU"}

# --- fixed values: network policy ---
IPV4_BLOCKS = [
    ("0.0.0.0/8", "unspecified address"), ("10.0.0.0/8", "private network (RFC1918)"), ("100.64.0.0/10", "carrier-grade NAT (RFC6598)"),
    ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local / cloud metadata (169.254.169.254)"), ("172.16.0.0/12", "private network (RFC1918)"),
    ("192.0.0.0/24", "IETF protocol assignments"), ("192.0.2.0/24", "documentation range (TEST-NET-1)"), ("192.168.0.0/16", "private network (RFC1918)"),
    ("198.18.0.0/15", "benchmarking range"), ("198.51.100.0/24", "documentation range (TEST-NET-2)"), ("203.0.113.0/24", "documentation range (TEST-NET-3)"),
    ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved (includes 255.255.255.255 broadcast)"),
]
SUSPICIOUS_HOSTS = [
    ("^localhost$", "localhost hostname"), (r"\.local$", "mDNS .local hostname"), (r"\.internal$", "internal hostname"), (r"\.localdomain$", "localdomain hostname"),
    (r"^metadata\.", "cloud metadata hostname"), ("^metadata$", "cloud metadata hostname"), (r"^169\.254\.", "cloud metadata address"), (r"\bmetadata\b", "metadata endpoint hostname"),
]
ERROR_STATUS = {
    "VALIDATION_ERROR": 400, "INVALID_URL": 400, "BLOCKED_URL": 400, "UNSUPPORTED_SCHEME": 400, "DOWNLOAD_FAILED": 502, "DOWNLOAD_TIMEOUT": 504,
    "DOWNLOAD_TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "INVALID_IMAGE": 400, "IMAGE_TOO_LARGE": 413, "UNAUTHORIZED": 401, "RATE_LIMITED": 429,
    "NOT_FOUND": 404, "ANALYSIS_FAILED": 500, "INTERNAL_ERROR": 500, "SERVICE_UNAVAILABLE": 503,
}
MAX_URL_LENGTH = 2048

# --- fixed values: image variants ---
VARIANTS = """original grayscale upscale2x upscale3x clahe sharpen otsu adaptive_threshold rotate_15 rotate_30 rotate_45 rotate_90 rotate_neg15
rotate_neg30 rotate_neg45 rotate_neg90 deskew perspective_correction auto_roi barcode_crop morph_close horiz_morphology sobel_x black_hat denoise
sauvola niblack auto_polarity gray_upscale2x gray_clahe clahe_upscale2x clahe_otsu clahe_adaptive roi_upscale2x roi_clahe roi_otsu roi_perspective
full_auto""".split()
PLANS = {
    "fast": "original grayscale clahe sharpen".split(),
    "standard": "original grayscale clahe sharpen otsu auto_polarity adaptive_threshold denoise upscale2x".split(),
    "deep": "original grayscale clahe sharpen otsu auto_polarity adaptive_threshold denoise upscale2x auto_roi barcode_crop deskew rotate_90 rotate_neg90 sauvola horiz_morphology roi_otsu upscale3x perspective_correction full_auto".split(),
}
OCR_PLAN = "gray_upscale2x gray clahe adaptive original".split()
TIERS = {
    "tier1": "original grayscale clahe sharpen".split(),
    "tier2": "otsu adaptive_threshold auto_polarity denoise upscale2x".split(),
    "tier3": "deskew auto_roi barcode_crop perspective_correction rotate_90 rotate_neg90 full_auto".split(),
}
CONTRACT_NAMES = {"original": "original", "resized": "upscale2x", "grayscale": "grayscale", "contrast-enhanced": "clahe", "sharpened": "sharpen", "denoised": "denoise", "thresholded": "otsu", "adaptive-threshold": "adaptive_threshold", "deskewed": "deskew", "perspective-corrected": "perspective_correction"}
SCALES, RETRY_SCALES = [800, 500, 300], [1000, 800, 600, 400, 250]
ANGLES = list(range(0, 91, 15))

# --- fixed values: engines: name, platform, license, 1-D, 2-D, status ---
SCANNERS = [
    ("ZXing", "Browser", "Open source", True, True, "available"), ("html5-qrcode", "Browser", "Open source", True, True, "available"),
    ("Quagga2", "Browser", "Open source", True, False, "available"), ("QuaggaJS", "Browser", "Open source", True, False, "deprecated"),
    ("zbar-wasm", "Browser", "Open source", True, False, "deprecated"), ("@sec-ant/zbar-wasm", "Browser", "Open source", True, False, "failed"),
    ("ZBar (zbar.wasm)", "Browser", "Open source", True, True, "available"), ("jsQR", "Browser", "Open source", False, True, "deprecated"),
    ("BarcodeDetector API", "Browser", "Open source", True, True, "available"), ("ZXing-C++", "Browser", "Open source", True, True, "available"),
    ("Scandit Barcode Scanner SDK", "Browser", "Commercial", True, True, "license_required"), ("Dynamsoft Barcode Reader", "Browser", "Commercial", True, True, "license_required"),
    ("Anyline Barcode Scanner", "Browser", "Commercial", True, True, "license_required"), ("STRICH", "Browser", "Commercial", True, False, "license_required"),
    ("Microblink (BlinkID / barcode)", "Browser", "Commercial", True, True, "license_required"), ("BarcodeAPI.org / Web Barcode Scanner libraries", "Browser", "Mixed", True, True, "not_implemented"),
    ("ZBar (native)", "Browser", "Open source", True, False, "not_implemented"), ("BoofCV", "Browser", "Open source", True, True, "platform_unsupported"),
    ("OpenCV / OpenCV.js", "Browser", "Open source", False, False, "not_implemented"), ("Google ML Kit Barcode Scanning", "Android", "Open source", True, True, "platform_unsupported"),
    ("Google Code Scanner", "Android", "Open source", True, True, "platform_unsupported"), ("ZXing Android Embedded / ZXing Android", "Android", "Open source", True, True, "platform_unsupported"),
    ("Apple Vision Framework / VisionKit", "iOS", "Open source", True, True, "platform_unsupported"), ("AVFoundation metadata detection", "iOS", "Open source", True, True, "platform_unsupported"),
    ("pyzbar / OpenCV+pyzbar", "Python", "Open source", True, False, "platform_unsupported"), ("zxing-cpp Python bindings / Pyzxing", "Python", "Open source", True, True, "platform_unsupported"),
    ("Dynamsoft SDKs (Node/Android/iOS/.NET/Python)", "Node.js", "Commercial", True, True, "license_required"), ("ZXing.Net (+ Windows/Maui bindings)", ".NET", "Open source", True, True, "platform_unsupported"),
    ("IronBarcode / Aspose.BarCode / Syncfusion / Spire / Leadtools", ".NET", "Commercial", True, True, "platform_unsupported"), ("Cognex DataMan SDK", ".NET", "Commercial", True, True, "platform_unsupported"),
    ("YOLO / TensorFlow.js / MediaPipe / ONNX Runtime / PaddleOCR / EasyOCR / Tesseract pipelines", "CV/AI", "Mixed", False, False, "not_implemented"),
]

# --- fixed values: what is shown for a state ---
STATUS_LABELS = {
    "available": "Available", "initializing": "Initializing", "running": "Running", "failed": "Failed", "license_required": "Requires SDK/license configuration", "browser_unsupported": "Not browser compatible",
    "platform_unsupported": "Needs native/mobile environment", "deprecated": "Unsupported/deprecated", "not_implemented": "Not implemented",
}
RACE_LABELS = {"found": "FOUND", "processing": "...", "failed": "FAILED", "miss": "MISS"}
CLASS_LABELS = {"correct": "CORRECT", "incorrect": "INCORRECT", "miss": "MISS"}


def scanners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SCANNERS)], "ord int, name string, platform string, license string, one_d boolean, two_d boolean, status string")


def canonical_unit(nutrient: str) -> str:
    return "kcal" if nutrient in KCAL_NUTRIENTS else "mg" if nutrient in MILLIGRAM_NUTRIENTS else "µg" if nutrient in MICROGRAM_NUTRIENTS else "g"


def fixed(x: float, digits: int) -> float:
    """Round the exact binary value half up, as fixed-point formatting of doubles does."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def consistency(observations: int) -> float:
    return 0.0 if observations <= 1 else 1.0 if observations >= 8 else fixed(log2(observations) / 3, 3)


def confidence_rows() -> list[tuple[int, int, str, str, int]]:
    """Every derived confidence without an engine's own: agreement (to 3), observations (to 8), structural kind, format, thousandths."""
    out = []
    for a, av in AGREEMENT.items():
        for n in range(1, 9):
            for s, sv in STRUCTURAL.items():
                for f, p in FORMAT_PRIOR.items():
                    x = av * WEIGHTS["agreement"] + consistency(n) * WEIGHTS["consistency"] + sv * WEIGHTS["structural"] + p * WEIGHTS["format_prior"] + 0.0 * WEIGHTS["engine"]
                    out.append((a, n, s, f, round(fixed(max(0.0, min(1.0, x)), 3) * 1000)))
    return out
