"""Values that must be these for right results: word lists, patterns, rules and tables. Logic is elsewhere."""

from __future__ import annotations

# ---- Fixed values: words by which English and romanised Hindi are told apart.
ENGLISH = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "had", "words")
HINDI = ("aur", "hai", "hain", "ke", "ki", "ka", "se", "me", "ko", "par", "tha", "thi", "the", "kya", "kaise", "kahan")

# ---- Fixed values: stop words of keyword sets.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "were", "will", "with", "this", "these", "those",
    "they", "them", "their", "there", "then", "than", "or", "but",
    "not", "have", "had", "do", "does", "did", "can", "could",
    "should", "would", "may", "might", "must", "shall",
)

# ---- Fixed values: boilerplate of pages, removed in any case.
BOILERPLATE = (
    r"copyright.*\d{4}",
    r"all rights reserved",
    r"privacy policy",
    r"terms of service",
    r"contact us",
    r"home\s*\|\s*about\s*\|\s*services",
    r"navigation menu",
    r"skip to main content",
    r"back to top",
)

# ---- Fixed values: technical terms by category.
TERMS = {
    "satellites": (
        "insat", "kalpana", "megha-tropiques", "scatsat", "oceansat", "cartosat", "resourcesat", "risat", "astrosat", "chandrayaan",
        "mangalyaan", "aditya", "isro", "gslv", "pslv",
    ),
    "instruments": (
        "vhrr", "ccd", "liss", "awi", "msmr", "madras", "saral", "altika", "scatterometer", "radiometer", "imager", "sounder",
        "payload", "sensor", "detector", "spectroradiometer",
    ),
    "parameters": (
        "sst", "chlorophyll", "aerosol", "precipitation", "humidity", "temperature", "pressure", "wind", "ozone", "radiation",
        "reflectance", "brightness", "normalized", "index", "anomaly",
    ),
    "applications": (
        "meteorology", "oceanography", "agriculture", "forestry", "disaster", "cyclone", "drought", "flood", "tsunami",
        "climate", "weather", "monsoon", "forecast", "monitoring",
    ),
}

# ---- Fixed values: patterns of satellite information, on lower-cased text.
SATELLITES = (
    r"insat[-\s]?(\d+[a-z]?)",
    r"kalpana[-\s]?(\d+)?",
    r"megha[-\s]?tropiques",
    r"scatsat[-\s]?(\d+)?",
    r"oceansat[-\s]?(\d+)?",
    r"cartosat[-\s]?(\d+[a-z]?)?",
    r"resourcesat[-\s]?(\d+[a-z]?)?",
    r"risat[-\s]?(\d+[a-z]?)?",
)
LAUNCHES = (
    r"launch(?:ed)?\s+(?:on\s+)?(\d{1,2}[-/]\d{1,2}[-/]\d{4})",
    r"launch(?:ed)?\s+(?:on\s+)?(\d{4})",
    r"(\d{1,2}\s+\w+\s+\d{4})\s+launch",
)
ORBITS = (
    r"(geostationary|polar|sun[-\s]?synchronous|elliptical)\s+orbit",
    r"orbit(?:al)?\s+(?:period|altitude|inclination)",
    r"(\d+)\s*km\s+(?:altitude|orbit)",
)
MISSIONS = (
    r"mission\s+(?:life|duration)?\s*:?\s*(\d+)\s*(?:years?|months?)",
    r"(?:primary|secondary)\s+mission",
    r"mission\s+(?:objectives?|goals?)",
)

# ---- Fixed values: patterns of entities by type, in any case.
ENTITY_PATTERNS = {
    "satellite": (
        r"(?:INSAT|insat)[-\s]?(\d+[A-Z]?)", r"(?:KALPANA|kalpana)[-\s]?(\d+)?", r"(?:MEGHA|megha)[-\s]?TROPIQUES?", r"(?:SCATSAT|scatsat)[-\s]?(\d+)?",
        r"(?:OCEANSAT|oceansat)[-\s]?(\d+)?", r"(?:CARTOSAT|cartosat)[-\s]?(\d+[A-Z]?)?", r"(?:RESOURCESAT|resourcesat)[-\s]?(\d+[A-Z]?)?",
        r"(?:RISAT|risat)[-\s]?(\d+[A-Z]?)?", r"(?:ASTROSAT|astrosat)", r"(?:CHANDRAYAAN|chandrayaan)[-\s]?(\d+)?", r"(?:MANGALYAAN|mangalyaan)", r"(?:ADITYA|aditya)[-\s]?L?(\d+)?",
    ),
    "instrument": (
        r"(?:VHRR|vhrr)", r"(?:CCD|ccd)", r"(?:LISS|liss)[-\s]?(\d+)?", r"(?:AWI|awi)", r"(?:MSMR|msmr)", r"(?:MADRAS|madras)", r"(?:SARAL|saral)", r"(?:ALTIKA|altika)",
        r"(?:SCATTEROMETER|scatterometer)", r"(?:RADIOMETER|radiometer)", r"(?:IMAGER|imager)", r"(?:SOUNDER|sounder)", r"(?:PAYLOAD|payload)", r"(?:SENSOR|sensor)",
        r"(?:DETECTOR|detector)", r"(?:SPECTRORADIOMETER|spectroradiometer)",
    ),
    "parameter": (
        r"(?:SST|sst|sea\s+surface\s+temperature)", r"(?:CHLOROPHYLL|chlorophyll)[-\s]?a?", r"(?:AEROSOL|aerosol)", r"(?:PRECIPITATION|precipitation)", r"(?:HUMIDITY|humidity)",
        r"(?:TEMPERATURE|temperature)", r"(?:PRESSURE|pressure)", r"(?:WIND|wind)\s+(?:speed|direction|vector)", r"(?:OZONE|ozone)", r"(?:RADIATION|radiation)", r"(?:REFLECTANCE|reflectance)",
        r"(?:BRIGHTNESS|brightness)\s+temperature", r"(?:NDVI|ndvi|normalized\s+difference\s+vegetation\s+index)", r"(?:ANOMALY|anomaly)", r"(?:SOIL\s+MOISTURE|soil\s+moisture)",
    ),
    "location": (
        r"(?:INDIA|india)", r"(?:INDIAN\s+OCEAN|indian\s+ocean)", r"(?:BAY\s+OF\s+BENGAL|bay\s+of\s+bengal)", r"(?:ARABIAN\s+SEA|arabian\s+sea)", r"(?:HIMALAYAS|himalayas)",
        r"(?:WESTERN\s+GHATS|western\s+ghats)", r"(?:GANGETIC\s+PLAINS|gangetic\s+plains)", r"(?:DECCAN\s+PLATEAU|deccan\s+plateau)", r"(?:MUMBAI|mumbai)", r"(?:DELHI|delhi)",
        r"(?:CHENNAI|chennai)", r"(?:KOLKATA|kolkata)", r"(?:BENGALURU|bengaluru)", r"(?:HYDERABAD|hyderabad)",
    ),
    "application": (
        r"(?:METEOROLOGY|meteorology)", r"(?:OCEANOGRAPHY|oceanography)", r"(?:AGRICULTURE|agriculture)", r"(?:FORESTRY|forestry)", r"(?:DISASTER\s+MANAGEMENT|disaster\s+management)",
        r"(?:CYCLONE|cyclone)\s+(?:tracking|monitoring|detection)", r"(?:DROUGHT|drought)\s+(?:monitoring|assessment)", r"(?:FLOOD|flood)\s+(?:monitoring|prediction)",
        r"(?:TSUNAMI|tsunami)\s+(?:warning|detection)", r"(?:CLIMATE|climate)\s+(?:monitoring|change)", r"(?:WEATHER|weather)\s+(?:forecasting|prediction)",
        r"(?:MONSOON|monsoon)\s+(?:monitoring|prediction)", r"(?:CROP|crop)\s+(?:monitoring|yield\s+estimation)", r"(?:WATER\s+RESOURCES|water\s+resources)",
    ),
    "organization": (
        r"(?:ISRO|isro)", r"(?:MOSDAC|mosdac)", r"(?:NRSC|nrsc)", r"(?:SAC|sac)", r"(?:VSSC|vssc)", r"(?:ISTRAC|istrac)", r"(?:LPSC|lpsc)", r"(?:IIRS|iirs)", r"(?:INCOIS|incois)",
        r"(?:IMD|imd)", r"(?:NCMRWF|ncmrwf)", r"(?:NIOT|niot)", r"(?:CMMACS|cmmacs)",
    ),
}

# ---- Fixed values: descriptions of entities by type; others are of "Entity of type".
DESCRIPTIONS = {
    "satellite": "Satellite system: ", "instrument": "Scientific instrument: ", "parameter": "Measurement parameter: ", "location": "Geographic location: ", "application": "Application domain: ",
    "organization": "Organization: ", "person": "Person: ", "product": "Product: ", "event": "Event: ",
}

# ---- Fixed values: parent of each entity type, and the types that each relation may join, in order.
PARENTS = {
    "satellite": "physical_object", "instrument": "equipment", "parameter": "measurement", "location": "spatial_entity", "organization": "agent", "application": "abstract_entity",
    "data_product": "information_object", "mission": "project", "phenomenon": "natural_entity", "algorithm": "process",
}
RELATIONS = (
    ("has_instrument", ("satellite",), ("instrument",)),
    ("measures", ("instrument",), ("parameter",)),
    ("observes", ("satellite",), ("location",)),
    ("operated_by", ("satellite",), ("organization",)),
    ("used_for", ("data_product", "parameter"), ("application",)),
    ("generates", ("instrument",), ("data_product",)),
    ("part_of", ("instrument", "satellite"), ("mission", "satellite")),
    ("processes", ("algorithm",), ("data_product", "parameter")),
    ("detects", ("instrument",), ("phenomenon",)),
    ("located_in", ("location",), ("location",)),
)

# ---- Fixed values: patterns of relations; braces name entity types.
RELATION_PATTERNS = {
    "has_instrument": (
        r"({satellite})\s+(?:has|carries|equipped\s+with|features)\s+(?:an?|the)?\s*({instrument})",
        r"({satellite})\s+(?:payload|instruments?):\s*({instrument})",
        r"({instrument})\s+(?:on|aboard|in)\s+({satellite})",
        r"({satellite})\s*[-–]\s*({instrument})",
    ),
    "measures": (
        r"({instrument})\s+(?:measures|detects|observes|monitors)\s+({parameter})",
        r"({parameter})\s+(?:measured|detected|observed|monitored)\s+(?:by|using|with)\s+({instrument})",
        r"({instrument})\s+(?:for|to)\s+(?:measure|detect|observe|monitor)\s+({parameter})",
        r"({parameter})\s+(?:data|measurements|observations)\s+(?:from|using)\s+({instrument})",
    ),
    "observes": (
        r"({satellite})\s+(?:observes|monitors|covers|studies)\s+({location})",
        r"({location})\s+(?:observed|monitored|covered|studied)\s+(?:by|using)\s+({satellite})",
        r"({satellite})\s+(?:over|above)\s+({location})",
        r"({location})\s+(?:coverage|observation|monitoring)\s+(?:by|from)\s+({satellite})",
    ),
    "operated_by": (
        r"({satellite})\s+(?:operated|managed|controlled)\s+(?:by|from)\s+({organization})",
        r"({organization})\s+(?:operates|manages|controls)\s+({satellite})",
        r"({satellite})\s+(?:mission|operation)\s+(?:by|from)\s+({organization})",
        r"({organization})\s*[-–]\s*({satellite})\s+(?:mission|operation)",
    ),
    "used_for": (
        r"({parameter}|{data_product})\s+(?:used|utilized|applied)\s+(?:for|in)\s+({application})",
        r"({application})\s+(?:using|utilizes|applies)\s+({parameter}|{data_product})",
        r"({parameter}|{data_product})\s+(?:for|in)\s+({application})\s+(?:applications?|studies?|research)",
        r"({application})\s+(?:requires|needs)\s+({parameter}|{data_product})",
    ),
    "part_of": (
        r"({instrument})\s+(?:part\s+of|component\s+of|in)\s+({satellite})",
        r"({satellite})\s+(?:includes|contains|has)\s+({instrument})",
        r"({instrument})\s+(?:subsystem|component)\s+(?:of|in)\s+({satellite})",
        r"({satellite})\s+(?:mission|system)\s+(?:includes|contains)\s+({instrument})",
    ),
    "located_in": (
        r"({location})\s+(?:in|within|inside)\s+({location})",
        r"({location})\s+(?:part\s+of|region\s+of)\s+({location})",
        r"({location})\s*[,]\s*({location})",
        r"({location})\s+(?:state|province|region)\s+(?:of|in)\s+({location})",
    ),
    "developed_by": (
        r"({satellite}|{instrument}|{algorithm})\s+(?:developed|built|designed)\s+(?:by|at)\s+({organization})",
        r"({organization})\s+(?:developed|built|designed)\s+({satellite}|{instrument}|{algorithm})",
        r"({satellite}|{instrument}|{algorithm})\s+(?:development|design)\s+(?:by|at)\s+({organization})",
        r"({organization})\s*[-–]\s*({satellite}|{instrument}|{algorithm})\s+(?:development|design)",
    ),
}
NEGATIVE = (r"(?:not|no|without|except|excluding)\s+", r"(?:unlike|different\s+from|compared\s+to)\s+", r"(?:if|when|while|although|though)\s+", r"(?:might|could|would|should|may)\s+")
TEMPORAL = (r"(?:since|from|during|in)\s+(\d{4}|\w+\s+\d{4})", r"(?:launched|operational|active)\s+(?:since|from|in)\s+(\d{4}|\w+\s+\d{4})", r"(?:between|from)\s+(\d{4})\s+(?:to|and)\s+(\d{4})")
SPATIAL = (r"(?:over|above|covering)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"(?:in|at|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"(?:region|area|zone):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)")
QUANTITATIVE = (
    r"(\d+(?:\.\d+)?)\s*(km|m|degrees?|%|Hz|GHz|MHz)",
    r"(?:resolution|accuracy|frequency):\s*(\d+(?:\.\d+)?)\s*(km|m|degrees?|%|Hz|GHz|MHz)",
    r"(?:approximately|about|around)\s+(\d+(?:\.\d+)?)\s*(km|m|degrees?|%|Hz|GHz|MHz)",
)
#: Properties of a relation that its context states, by relation: (property, pattern).
STATED = {
    "measures": (("measurement_accuracy", r"accuracy[:\s]+([^,\.\s]+)"), ("measurement_frequency", r"frequency[:\s]+([^,\.\s]+)")),
    "observes": (("coverage_area", r"coverage[:\s]+([^,\.\s]+)"), ("spatial_resolution", r"resolution[:\s]+([^,\.\s]+)")),
    "operated_by": (("role", r"(?:role|responsibility)[:\s]+([^,\.\s]+)"),),
}

# ---- Fixed values: page types, by substrings of the url and then of the title, in order.
PAGE_TYPES_BY_URL = (
    ("product", ("product",)), ("satellite", ("satellite",)), ("faq", ("faq",)), ("documentation", ("documentation", "manual")),
    ("news", ("news", "announcement")), ("service", ("service",)), ("about", ("about",)), ("contact", ("contact",)),
)
PAGE_TYPES_BY_TITLE = (("product", ("product",)), ("satellite", ("satellite",)), ("faq", ("faq", "frequently asked")))

# ---- Fixed values: categories, by page type and then by substrings of the content, in order.
CATEGORIES_BY_PAGE = {"faq": "FAQ", "product": "Product", "satellite": "Satellite", "documentation": "Documentation", "news": "News"}
CATEGORIES_BY_TEXT = (
    ("Weather", ("weather", "meteorology", "climate")),
    ("Ocean", ("ocean", "sea", "marine")),
    ("Agriculture", ("agriculture", "crop", "farming")),
    ("Disaster Management", ("disaster", "emergency", "cyclone")),
)

# ---- Fixed values: what isn't processed, and what a crawl skips.
EXCLUDED_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".tar", ".gz", ".exe", ".dmg")
EXCLUDED_CONTENT_TYPES = ("application/pdf", "application/msword", "application/excel", "application/zip", "application/x-zip-compressed")
SKIPPED_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".tar", ".gz")

# ---- Fixed values: selectors of page regions, tried in order.
SELECTORS = {
    "main_content": ("#main-content", ".main-content", "main", ".content"),
    "navigation": ("nav", ".navigation", ".nav-menu"),
    "breadcrumbs": (".breadcrumb", ".breadcrumbs"),
    "sidebar": (".sidebar", ".side-menu", "aside"),
    "footer": ("footer", ".footer"),
}
ALLOWED_TAGS = ("p", "br", "strong", "em", "u", "ol", "ul", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "code", "pre", "a", "img")
ALLOWED_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "*": ("class", "id")}

# ---- Fixed values: patterns that queries may not hold.
HARMFUL = (r"<script", r"javascript:", r"onload=", r"onerror=", r"eval\(")
FORBIDDEN = (r"<script", r"javascript:", r"onload=", r"onerror=", r"eval\(", r"document\.cookie", r"window\.location")
SQL_PATTERNS = (r"DROP\s+TABLE", r"DELETE\s+FROM", r"UPDATE\s+SET", r"INSERT\s+INTO")
PHONES = (r"^\+?1?[2-9]\d{9}$", r"^\+?[1-9]\d{1,14}$", r"^\d{10}$")
PASSWORD_SYMBOLS = r'[!@#$%^&*(),.?":{}|<>]'

# ---- Fixed values: questions and answers; the second needs numbered questions or the text's end.
QA = r"(?is)Q\s*:?\s*(.+?)\s*A\s*:?\s*(.+?)(?=Q\s*:?|$)"
FAQ = r"(?s)(\d+\.\s*)?(.+\?)\s*\n\s*(.+?)(?=\n\s*\d+\.|$)"

# ---- Fixed values: requests a minute by path prefix, in the order in which the first match counts.
RATE_LIMITS = (("/api/v1/chat", 20), ("/api/v1/search", 30), ("/api/v1/documents/upload", 5), ("/api/v1/scraper/start", 2))
DEFAULT_LIMIT = 100
