"""Fixed values of the label rules and comparators: word lists, patterns and texts that results depend on."""

from __future__ import annotations

# State names in the order in which they are replaced, and their codes.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in",
    "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd",
    "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc",
    "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
STATE_CODES = list(STATES.values())

# Names of the United States, values that declare nothing, words that do not tell producers apart.
USA_NAMES = ["usa", "us", "u.s.", "u.s.a.", "united states", "united states of america", "america"]
NO_DECLARATION = ["", "-", "n/a", "na", "none", "not applicable", "null"]
NOISE_TOKENS = ["the", "of", "and", "by", "a", "an", "on", "used", "label", "dba", "tradename"]
PROCESS_TOKENS = ["distilled", "bottled", "brewed", "canned", "produced", "imported", "blended", "packed", "fermented"]
CORPORATE_TOKENS = ["l", "llc", "inc", "corp", "co", "ltd", "company", "incorporated", "llp"]
CORPORATE_SUFFIX = r"\b(l\.?l\.?c\.?|inc\.?|corp\.?|co\.?|ltd\.?|company|incorporated|llp)\b\.?"
PRODUCER_THRESHOLD = 0.4

# Class and type names that stand for each other.
CLASS_FAMILIES = [
    ["bourbon", "bourbon whiskey", "kentucky straight bourbon whiskey"],
    ["whiskey", "whisky"],
    ["ipa", "india pale ale"],
    ["pale ale", "ipa", "india pale ale"],
    ["ale"],
    ["lager"],
    ["beer", "malt beverages"],
    ["malt beverages", "beer"],
    ["vodka"],
    ["rum"],
    ["gin"],
    ["tequila"],
    ["distilled spirits", "spirits"],
]

# Patterns of product families over normalised text.
WINE_WORDS = r"\b(?:wine|port|sherry|vermouth|champagne|riesling|chardonnay|cabernet|merlot|pinot|sauvignon|moscato|zinfandel|barbera|syrah|shiraz|malbec)\b"
MALT_WORDS = r"\b(?:malt|beer|ale|lager|stout|porter|ipa|pilsner|weisse|saison)\b"
SPIRIT_WORDS = (
    r"\b(?:spirits?|whiskey|whisky|vodka|rum|gin|tequila|bourbon|brandy|cognac|mezcal|liqueur|cordial|schnapps|absinthe|amaro"
    r"|aquavit|ouzo|sotol|pisco|grappa|distilled|blanco|reposado|anejo)\b"
)
FAMILIES = ["WINE", "MALT BEVERAGES", "DISTILLED SPIRITS"]
WINE_STYLES = [
    r"\b(?:red|white|rose|rosé|pink)\s+wine\s+blend\b",
    r"\b(?:red|white|rose|rosé|pink)\s+blend\b",
    r"\b(?:sweet|dry|semi dry|semi-dry)\s+(?:red|white|rose|rosé|pink)\b",
    r"\b(?:table|dessert|sparkling|carbonated|fruit|honey|rice)\s+wine\b",
    r"\b(?:hard cider|cider|mead|sake)\b",
]

# The health warning, its parts and the words that identify them.
WARNING_PREFIX = "GOVERNMENT WARNING:"
WARNING_SENTENCE_1 = (
    "(1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects."
)
WARNING_SENTENCE_2 = (
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
WARNING = f"{WARNING_PREFIX} {WARNING_SENTENCE_1} {WARNING_SENTENCE_2}"
ANCHORS_1 = ["according", "surgeon", "general", "women", "should", "drink", "alcoholic", "pregnancy", "birth", "defects"]
ANCHORS_2 = ["consumption", "alcoholic", "beverages", "impairs", "ability", "drive", "operate", "machinery", "health", "problems"]
ANCHOR_SHARE = 0.85

# Formats of label values.
PERCENT = r"\b\d{1,2}(\.\d{1,2})?\s*%"
PROOF = r"(?i)\bproof\b"
BARE_NUMBER = r"^\d{1,2}(\.\d{1,2})?$"
NET_CONTENTS = r"(?i)^\d+(\.\d+)?\s*(ml|l|fl\s*oz|fluid\s+ounces?)$"

# Secrets in error texts, in the order in which they are masked.
SECRETS = [
    r"sk-(?:proj-|svcacct-|None-|live-)?[A-Za-z0-9_\-]{20,}",
    r"(?i)Bearer\s+[A-Za-z0-9_\-.+/=]{20,}",
    r"""(?i)Authorization:\s*[^\s,"}]+""",
    r"sk-ant-[A-Za-z0-9_\-]{20,}",
    r"(?i)api-key:\s*[A-Za-z0-9_\-]+",
]
REDACTED = "[REDACTED]"
ERROR_CATEGORIES = [
    ("provider_rejected", r"(?i)invalid.*header|invalid_api_key|incorrect api key|401|unauthorized"),
    ("rate_limited", r"(?i)rate limit|429"),
    ("timed_out", r"(?i)timeout|timed out"),
    ("declined", r"(?i)safety|content_policy|content policy"),
]

# Grape names and their other names.
VARIETALS = {
    "Agiorgitiko": [], "Albariño": ["Albarino"], "Alicante Bouschet": [], "Aligoté": ["Aligote"], "Arneis": [], "Baga": [], "Barbera": [],
    "Blaufränkisch": ["Blaufrankisch", "Lemberger"], "Cabernet Franc": [], "Cabernet Sauvignon": [], "Carménère": ["Carmenere"],
    "Carignan": ["Carignane"], "Catawba": [], "Chambourcin": [], "Chancellor": [], "Charbono": [], "Chardonnay": [], "Chenin Blanc": [],
    "Cinsaut": ["Cinsault"], "Clarion": [], "Colombard": ["French Colombard"], "Colorino": ["Lambrusco Colorino"], "Concord": [], "Corvina": [],
    "Counoise": [], "Dolcetto": [], "Durif": ["Petite Sirah", "Petite Syrah"], "Fiano": [], "Frontenac": [], "Gamay": [],
    "Gewürztraminer": ["Gewurztraminer"], "Greco Bianco": [], "Grenache": ["Garnacha"], "Grenache Blanc": ["Garnacha Blanca"],
    "Grenache Gris": ["Garnacha Roja"], "Grüner Veltliner": ["Gruner Veltliner"], "Malbec": [], "Malmsey": [], "Marquette": [], "Marsanne": [],
    "Melon": [], "Merlot": [], "Mourvèdre": ["Mourvedre", "Mataro", "Monastrell"], "Müller-Thurgau": ["Muller Thurgau", "Mueller Thurgau"],
    "Muscat": ["Moscato", "Muscat Blanc", "Muscat Canelli"], "Muscadelle": [], "Nebbiolo": [], "Niagara": [], "Norton": ["Cynthiana"],
    "Palomino": [], "Pecorino": [], "Petit Verdot": [], "Picpoul Blanc": ["Piquepoul Blanc"], "Pinot Blanc": [], "Pinot Gris": ["Pinot Grigio"],
    "Pinot Meunier": ["Meunier"], "Pinot Noir": [], "Primitivo": [], "Riesling": [], "Roussanne": [], "Ruby Cabernet": [], "Sangiovese": [],
    "Sauvignon Blanc": ["Fumé Blanc", "Fume Blanc"], "Sémillon": ["Semillon"], "Seyval Blanc": [], "St. Croix": ["Saint Croix"], "Syrah": ["Shiraz"],
    "Tannat": [], "Tempranillo": [], "Teroldego": [], "Tinta Amarela": ["Trincadeira"], "Tinta Cão": ["Tinta Cao"], "Tinto Cão": ["Tinto Cao"],
    "Touriga Franca": ["Touriga Francesa"], "Touriga Nacional": [], "Traminette": [], "Trebbiano": ["Ugni Blanc"],
    "Valdiguié": ["Valdiguie", "Napa Gamay"], "Verdejo": [], "Verdelho": [], "Verdicchio": [], "Vermentino": ["Rolle"], "Vidal Blanc": [],
    "Vignoles": ["Ravat 51"], "Viognier": [], "Zinfandel": [], "Zweigelt": [],
}

# Appellations. States follow from STATES by capitals.
WINE_REGIONS = [
    "American", "Applegate Valley", "Arroyo Grande Valley", "Arroyo Seco", "Atlas Peak", "Augusta", "Ballard Canyon", "Calistoga", "California",
    "Carneros", "Central Coast", "Chalk Hill", "Chalone", "Columbia Gorge", "Columbia Valley", "Coombsville", "Dry Creek Valley", "Dundee Hills",
    "Edna Valley", "El Dorado", "Eola-Amity Hills", "Finger Lakes", "Happy Canyon of Santa Barbara", "High Valley", "Horse Heaven Hills",
    "Howell Mountain", "Knights Valley", "Lake Michigan Shore", "Livermore Valley", "Lodi", "Los Carneros", "Mendocino", "Monterey", "Mt. Harlan",
    "Napa Valley", "North Coast", "Oak Knoll District", "Oakville", "Paso Robles", "Red Hills Lake County", "Red Mountain", "Ribbon Ridge", "Rockpile",
    "Rogue Valley", "Russian River Valley", "Rutherford", "Santa Barbara County", "Santa Cruz Mountains", "Santa Lucia Highlands", "Santa Maria Valley",
    "Santa Rita Hills", "Santa Ynez Valley", "Seneca Lake", "Shenandoah Valley", "Sierra Foothills", "Snipes Mountain", "Sonoma Coast",
    "Sonoma County", "Sonoma Mountain", "Sonoma Valley", "Spring Mountain District", "Stags Leap District", "Sta. Rita Hills", "Suisun Valley",
    "Umpqua Valley", "Wahluke Slope", "Walla Walla Valley", "Willamette Valley", "Yakima Valley", "Yamhill-Carlton",
]
WINE_COUNTRIES = [
    "Argentina", "Australia", "Austria", "Bordeaux", "Bourgogne", "Canada", "Chile", "France", "Germany", "Italy", "Marlborough", "Mendoza",
    "Mexico", "New Zealand", "Portugal", "Rioja", "South Africa", "Spain",
]
APPELLATIONS = {"American": ["USA", "U.S.A.", "United States", "United States of America"]}
for _name in [*(" ".join(w.capitalize() for w in s.split()) for s in STATES), *WINE_REGIONS, *WINE_COUNTRIES]:
    APPELLATIONS.setdefault(_name, ["Burgundy"] if _name == "Bourgogne" else [])

# Printed text that tells a form's page, a label's page, and the sides of a label.
FORM_MARKERS = [
    "PART I - APPLICATION", "BRAND NAME", "TYPE OF PRODUCT", "PLANT REGISTRY", "SERIAL NUMBER", "TYPE OF APPLICATION", "NAME AND ADDRESS OF APPLICANT", "FANCIFUL NAME",
]
LABEL_MARKERS = ["AFFIX COMPLETE SET OF LABELS", "Image Type:", "Brand (front)"]
FRONT_MARKERS = ["Brand (front) or keg collar", "Brand (front)", "or keg collar"]
BACK_MARKERS = ["Image Type: Back"]
