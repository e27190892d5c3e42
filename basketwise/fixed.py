"""Fixed values of the price and basket rules."""

# Written unit -> (dimension, factor to the base unit g / ml / pz).
UNITS = {
    "kg": ("mass", 1000), "kilo": ("mass", 1000), "kilos": ("mass", 1000),
    "g": ("mass", 1), "gr": ("mass", 1), "gramos": ("mass", 1),
    "l": ("volume", 1000), "lt": ("volume", 1000), "litro": ("volume", 1000), "litros": ("volume", 1000),
    "ml": ("volume", 1), "mililitros": ("volume", 1),
    "pz": ("count", 1), "pza": ("count", 1), "pzas": ("count", 1), "pieza": ("count", 1), "piezas": ("count", 1),
    "lata": ("count", 1), "latas": ("count", 1), "rollo": ("count", 1), "rollos": ("count", 1),
    "botella": ("count", 1), "botellas": ("count", 1), "huevo": ("count", 1), "huevos": ("count", 1),
    "pqte": ("pack", 1), "paquete": ("pack", 1), "paquetes": ("pack", 1),
    "cartera": ("pack", 1), "carteras": ("pack", 1), "six": ("pack", 1), "sixpack": ("pack", 1),
}

# Word between a quantity and what it counts, and the notes on converted quantities.
LINK_WORD = "de"
NOTE_CONVERTED = "pediste %s %s · cada presentación trae %s %s"
NOTE_GUESSED = "no se pudo convertir %s %s a presentaciones; se asumió 1"

# Dimension measured by each base unit.
DIMENSION_OF_BASE = {"g": "mass", "ml": "volume", "pz": "count"}

# Chain name as published in the survey (normalised) -> store id.
SURVEY_CHAINS = {
    "bodega aurrera": "aurrera",
    "chedraui": "chedraui",
    "wal-mart": "walmart",
    "walmart": "walmart",
    "hipermercado soriana": "soriana",
    "soriana": "soriana",
    "mega soriana": "soriana",
    "la comer": "lacomer",
    "fresko": "lacomer",
}
SURVEY_STATE = "queretaro"
SURVEY_SOURCE = "profeco-qqp"
SURVEY_WINDOW_HALVES = 24
SURVEY_OLD_DAYS = 45
SURVEY_DATE = r"(\d{4})[/-](\d{2})[/-](\d{2})"

# Source labels of the other feeds.
MANUAL_SOURCE = "captura-manual"
PAGE_SOURCE = "chedraui-live"
PAGE_BLOCK = r"""(?i)<script\s+type=["']application/ld\+json["']>([\s\S]*?)</script>"""
SEARCH_SOURCE = "serpapi-walmart"
SEARCH_ITEM_URL = "https://www.walmart.com.mx/ip/"

# Brands looked up in a product name, first hit wins.
BRANDS = [
    "lala", "san juan", "fud", "nutrioli", "verde valle", "dolores",
    "mccormick", "nescafe", "barilla", "bimbo", "petalo", "ariel",
    "cloralex", "axion", "coca-cola", "coca cola", "corona", "bonafont",
]

# Variant stems that disqualify a title unless asked for.
VARIANT_STEMS = [
    "light", "deslactosad", "descremad", "semidescremad", "descafeinad",
    "sin azucar", "zero", "cero", "premium", "integral",
]

# Flavour / grade words that must appear when the product has them.
REQUIRED_WORDS = ["limon", "super extra"]

# Unit words and the spellings accepted for them in a title.
UNIT_WORD_SPELLINGS = {
    ("litros", "litro"): r"\b(l|litro|litros)\b",
    ("gramos", "gramo"): r"\b(g|gr|gramo|gramos)\b",
    ("kilos", "kilo"): r"\b(kg|kilo|kilos|kilogramos)\b",
    ("piezas", "pieza"): r"\b(pz|pza|pzas|pieza|piezas)\b",
}

# How titles name packs of several.
COUNTED_PACK = r"\b\d+\s*pack\b"
COUNTED_PIECES = r"\b\d+\s*pzas?\b"
MULTIPACK_WORDS = ["6 pack", "4 pack", "12 pack", "c/u"]
PIECE_WORDS = ["pzas", "piezas"]

# Weights that contradict a 1 kg product.
NOT_ONE_KILO = ["2 kg", "2kg", "3 kg", "4 kg", "4kg", "500 g"]

# Filler price of an item outside the catalog (base, store factors).
FILLER_BASE = 35.0
FILLER_FACTORS = {
    "aurrera": 0.94, "chedraui": 0.96, "walmart": 1.05,
    "soriana": 1.02, "lacomer": 1.15, "heb": 1.08,
}
CUSTOM_CATEGORY = "despensa"

# Limits.
MAX_PRICE = 100000
MAX_SHARED_ITEMS = 60
MAX_SHARED_QUANTITY = 999
MAX_NAME = 120
MAX_UNIT = 20
SUGGESTIONS_KEPT = 80
SUGGESTIONS_SHOWN = 50
REJECTS_SHOWN = 5
STALE_DAYS = 14
BAR_FLOOR_PERCENT = 15

# Price document defaults.
DOCUMENT_DEFAULTS = {
    "source": "desconocida",
    "sourceLabel": "Origen no declarado",
    "currency": "MXN",
}
SNAPSHOT_HEADER = {
    "currency": "MXN",
    "region": "Queretaro, Qro., MX",
    "postalCode": "76000",
}

# Freshness wording.
FRESHNESS = {
    "none": "sin fecha", "today": "hoy", "yesterday": "ayer",
    "days": "hace %d días", "month": "hace 1 mes", "months": "hace %d meses",
}

# Words of a store list.
FULFILLMENT = {"pickup": "Recoger en tienda", "delivery": "Entrega a domicilio"}
LIST_FOOTER = "Confirma existencias, cobertura y costo final directamente con el supermercado."

# Lines of a plan message.
PLAN_TOTAL = "💰 *Total Optimizado:* $%.2f MXN"
PLAN_SAVINGS = "🎉 *Ahorro Estimado:* $%.2f MXN (%d%%)"
PLAN_STORE = "📍 *%s* — %s (Subtotal: $%.2f):"
PLAN_ITEM = "  • %s (%s) -> $%.2f"
PLAN_UNPRICED = "⚠️ *Sin precio (revisar en tienda):* %s"
PLAN_FRESHNESS = "_Precios de referencia actualizados %s._"
