"""Word lists, lookup tables, patterns and limits.

Everything in this module is plain data that must have exactly these values for
results to be right.  All of it is a default: each operator that uses a list
takes it as an argument, so other vocabularies can be passed in.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Categories and title vocabulary
# --------------------------------------------------------------------------
CATEGORIES = [
    "Música", "Teatro", "Cine", "Danza", "Humor", "Gastronomía", "Deporte",
    "Infantil", "Formación", "Exposición", "Carnaval", "Fiesta", "Otros",
]
DEFAULT_CATEGORY = "Otros"

CATEGORY_WORDS = [
    "música", "musica", "teatro", "cine", "danza", "deporte", "cultura", "humor",
    "arte", "concierto", "festival", "espectáculo", "espectaculo", "evento",
    "eventos", "exposición", "exposicion", "charla", "conferencia",
]

GENERIC_TITLE_PHRASES = [
    "entradas para los mejores eventos", "entradas para",
    "tickets for the best events", "tickets for", "compra tus entradas",
    "anuncio genérico", "entradas", "abono", "bono", "agenda gc", "inicio -",
    "entrees", "tomaticket", "tickety", "comprar entradas",
    "eventos en gran canaria", "inicio - entradascanarias",
]

BOILERPLATE_PHRASES = [
    "condiciones de compra", "condiciones generales", "política de privacidad",
    "aviso legal", "cambios o devoluciones", "cambios ni devoluciones", "cookies",
    "copyright", "newsletter", "suscríbete", "términos y condiciones",
    "protección de datos", "ley orgánica", "responsabilidad del organizador",
    "footer", "síguenos en", "todos los derechos", "barra libre", "mayores de 18",
]

JUNK_TITLES = ["ext", "nan", "none", "null", ""]
QA_JUNK_TITLES = ["ext", "none"]
SOCIAL_IN_TITLE = ["youtube", "facebook", "instagram"]
SOCIAL_IN_URL = ["youtube", "facebook", "twitter"]

# Phrases dropped from a canonical title, longest first.
TITLE_STOP_PHRASES = [
    "en las palmas de gran canaria", "en gran canaria", "en las palmas",
    "entradas para", "tickets for", "25/26", "2025", "2026",
]
# Noise removed from an occurrence key, in this order.
OCCURRENCE_NOISE = ["en concierto", "concierto de", "concierto", "live", "gira", " en "]

TITLE_SUFFIXES = [
    " en canarias en vivo - concierto en las palmas",
    " en canarias en vivo - festival en las palmas",
    " en canarias en vivo concierto en las palmas",
    " en canarias en vivo",
    " - concierto en las palmas",
    " - festival en las palmas",
    " concierto en las palmas",
    " canarias en vivo",
]
REGION_SUFFIXES = [
    "las palmas de gran canaria", "las palmas", "gran canaria", "islas canarias",
    "canarias", "telde", "infecar",
]
DEFAULT_NAME = "Evento Cultural"

# --------------------------------------------------------------------------
# Text tokens that stand for a missing value, display defaults
# --------------------------------------------------------------------------
NULL_TOKENS = ["", "nan", "None", "<NA>", "NaN"]
PUBLISH_NULL_TOKENS = ["nan", "None", "NaT", ""]
PLACE_NULL_TOKENS = ["Sin especificar", "", "nan", "NaN"]
BLANK_HOUR_TOKENS = ["nan", "none", "<na>"]
PRICE_UNKNOWN = "Consultar"
PRICE_FREE = "Gratis"
HOUR_UNKNOWN = "Hora por confirmar"
PLACE_UNKNOWN = "Recinto por confirmar"
AI_TAGS = ["[Descripción generada por IA]", "[Generado por IA]"]

# --------------------------------------------------------------------------
# Patterns and limits of the field extractors
# --------------------------------------------------------------------------
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11,
    "diciembre": 12, "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6,
    "jul": 7, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dic": 12,
}
PRICE_RANGE = r"(\d+[.,]?\d*)\s*(?:-|al|y)\s*(\d+[.,]?\d*)\s*(?:€|EUR|euros)"
PRICE_FROM = r"(?:desde|a partir de|precio)\s*:?\s*(\d+[.,]?\d*)"
PRICE_AMOUNT = r"(?:€|EUR|euros)\s*(\d+[.,]?\d*)|(\d+[.,]?\d*)\s*(?:€|EUR|euros)"
PRICE_CARD = r"(\d+[.,]?\d*)\s*€"
FREE_WORDS = ["gratis", "gratuito", "entrada libre", "free"]
DATE_ISO = r"(\d{4})-(\d{2})-(\d{2})"
DATE_DMY = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
DATE_SPAN = r"(\d{1,2})\s+(?:al|y|de|a)\s+(\d{1,2})\s+de\s+(\w+)\s+(20\d{2})?"
DATE_TEXT = r"(\d{1,2})\s+de\s+(\w+)(?:\s+(?:de\s+)?(20\d{2}))?"
DATE_DAY_MONTH = r"(\d{1,2})\s+(?:de\s+)?([a-zA-Z]+)"
DATE_DOT_RANGE = r"(\d{2})\.(\d{2})\.(\d{4})\s*-\s*(\d{2})\.(\d{2})\.(\d{4})"
DATE_DOT = r"(\d{2})\.(\d{2})\.(\d{4})"
DATE_LAST_DAY = r"(?:al|y)\s+(\d{1,2})\s+de\s+([a-zA-Z]+)"
HOUR_AT = r"a\s+las?\s+([012]?\d)[:.h]([0-5]\d)"
HOUR_CLOCK = (
    r"(?:^|[\s,;(T])([012]?\d)[:.h]([0-5]\d)(?:\s*(?:h|hrs?|horas?))?"
    r"(?!\s*(?:€|euros|%|[$]))(?:\b|$)"
)
HOUR_SHORT = (
    r"(?:^|[\s,;(T])(\d{1,2})(?:\s*(?:h|hrs|horas))(?!\s*(?:€|euros|%|[$]))(?:\b|$)"
)
HOUR_PLAIN = r"(\d{1,2})[:.hH](\d{2})"
ADDRESS = (
    r"(?:en\s+(?:el|la|los|las)\s+)?"
    r"((?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Campus|Salón de actos|Edificio)"
    r"\s+[^.,:;\n]{3,60})"
)
DIGITS_ONLY_NAME = r"^[\d\s\-.,;:]+$"
TWO_NUMBER_GROUPS = r"\b\d{3}\b.*\b\d{3}\b"
MAP_LINK_COORDS = r"q=([-\d.]+),([-\d.]+)"
EXPORT_DATE = r"^\d{4}-\d{2}-\d{2}$"
YEAR_MIN, YEAR_MAX = 2024, 2030
PRICE_LIMIT_PARSE = 500.0
PRICE_LIMIT_AUDIT = 300.0
PRICE_LIMIT_QA = 500.0
IMPROBABLE_HOURS = ["05:00", "06:00", "07:00"]
SENTINEL_HOURS = ["22:33", "00:00", "12:04", "10:31"]
BAD_IMAGE_TOKENS = ["data:image", "transparent.gif", "placeholder", "empty.png"]
MIN_IMAGE_URL = 15
LOCAL_ZONE = "Atlantic/Canary"

# --------------------------------------------------------------------------
# places
# --------------------------------------------------------------------------
GENERIC_PLACES = [
    "gran canaria", "las palmas", "las palmas de gran canaria", "españa", "espana",
    "canarias", "islas canarias", "sin especificar", "",
]
PLACE_LEAK_PHRASES = [
    "paseo nocturno", "prepárate", "descubre", "que no olvidarás",
    "la cara más natural", "calle y los", "plaza y", "disfruta", "sumérgete",
    "vive la experiencia", "te esperamos", "no te pierdas", "aventura",
    "te invitamos", "https://", "conoce al autor", "abierto al público",
    "te imaginas", "asombroso", "fantástico", "reservando", "incluye", "taquilla",
    "entrada libre",
]
# (alternatives, canonical name); each alternative is a set of parts that must
# all occur in the folded place.
VENUE_ALIASES = [
    ([["kraus"], ["auditorio alfredo"]], "Auditorio Alfredo Kraus"),
    ([["galdos", "perez"]], "Teatro Pérez Galdós"),
    ([["guiniguada"]], "Teatro Guiniguada"),
    ([["cicca"]], "Fundación CICCA"),
    ([["cuyas"]], "Teatro Cuyás"),
    ([["victor jara"]], "Teatro Víctor Jara"),
    ([["gran canaria arena"], ["gc arena"]], "Gran Canaria Arena"),
    ([["infecar"]], "INFECAR"),
    ([["estadio de gran canaria"]], "Estadio de Gran Canaria"),
]
CENTRE_COORDS = (28.1235, -15.4363)
BBOX = {"lat": (27.5, 28.3), "lon": (-16.0, -15.2)}
MAP_LATITUDES = (27.0, 30.0)
EARTH_RADIUS_KM = 6371.0
NO_COORDS_DISTANCE = 9999.0

# Folded place -> coordinates; the order decides between partial matches.
PLACE_COORDS = [
    ("teatro guiniguada", 28.1030, -15.4160),
    ("auditorio alfredo kraus", 28.1300, -15.4470),
    ("auditorio a. kraus", 28.1300, -15.4470),
    ("auditorio kraus", 28.1300, -15.4470),
    ("alfredo kraus", 28.1300, -15.4470),
    ("teatro perez galdos", 28.1020, -15.4130),
    ("cicca", 28.1040, -15.4150),
    ("teatro cuyas", 28.106512, -15.418036),
    ("sala scala", 28.0938, -15.4168),
    ("gran canaria arena", 28.1137, -15.4449),
    ("edificio miller", 28.1396, -15.4305),
    ("museo elder", 28.1325, -15.4345),
    ("elder", 28.1325, -15.4345),
    ("centro atlantico de arte moderno", 28.1000, -15.4145),
    ("caam", 28.1000, -15.4145),
    ("casa de colon", 28.1003, -15.4155),
    ("castillo de mata", 28.1058, -15.4195),
    ("centro penitenciario las palmas", 28.083, -15.400),
    ("casa africa", 28.1010, -15.4148),
    ("gabinete literario", 28.1077, -15.4165),
    ("parque santa catalina", 28.1340, -15.4320),
    ("parque san telmo", 28.1140, -15.4270),
    ("parque doramas", 28.1185, -15.4295),
    ("plaza de la musica", 28.1310, -15.4475),
    ("plaza de las ranas", 28.1060, -15.4165),
    ("plaza del pilar", 28.1000, -15.4140),
    ("recinto ferial", 28.0860, -15.4530),
    ("infecar", 28.0860, -15.4530),
    ("sala miller", 28.1335, -15.4340),
    ("paper club", 28.1145, -15.4275),
    ("the paper club", 28.1145, -15.4275),
    ("la azotea", 28.1120, -15.4250),
    ("el sotano", 28.1098, -15.4230),
    ("sala insular de teatro", 28.1008, -15.4142),
    ("canarias en vivo", 28.1125, -15.4310),
    ("calle matagalpa", 28.1125, -15.4310),
    ("campus obelisco", 28.1020, -15.4180),
    ("campus del obelisco", 28.1020, -15.4180),
    ("campus universitario de tafira", 28.0700, -15.4530),
    ("ulpgc", 28.0700, -15.4530),
    ("facultad de humanidades", 28.1020, -15.4180),
    ("salon de actos del edificio de humanidades", 28.1020, -15.4180),
    ("estadio de gran canaria", 28.1000, -15.4560),
    ("estadio gran canaria", 28.1000, -15.4560),
    ("las palmas de gran canaria", 28.1235, -15.4363),
    ("las palmas", 28.1235, -15.4363),
    ("telde", 27.9945, -15.4165),
    ("arucas", 28.1200, -15.5230),
    ("galdar", 28.1470, -15.6500),
    ("aguimes", 27.9060, -15.4450),
    ("ingenio", 27.9160, -15.4360),
    ("santa lucia de tirajana", 27.9120, -15.5410),
    ("san bartolome de tirajana", 27.9245, -15.5730),
    ("maspalomas", 27.7600, -15.5860),
    ("playa del ingles", 27.7580, -15.5730),
    ("mogan", 27.8850, -15.7620),
    ("puerto de mogan", 27.8170, -15.7660),
    ("teror", 28.0590, -15.5470),
    ("firgas", 28.1070, -15.5620),
    ("valsequillo", 27.9830, -15.4970),
    ("vecindario", 27.8420, -15.4380),
    ("santa brigida", 28.0310, -15.4720),
    ("vega de san mateo", 28.0100, -15.5290),
    ("artenara", 28.0195, -15.6450),
    ("tejeda", 27.9945, -15.6140),
    ("moya", 28.1115, -15.5820),
    ("guia", 28.1390, -15.6350),
    ("san nicolas", 27.9870, -15.7810),
    ("agaete", 28.1000, -15.6990),
    ("puerto de la luz", 28.1400, -15.4250),
    ("gran canaria", 28.1235, -15.4363),
]

# Pattern in folded text -> venue; first pattern in this order wins.
VENUE_PATTERNS = [
    ("teatro cuyas", "Teatro Cuyás"),
    ("teatro guiniguada", "Teatro Guiniguada"),
    ("teatro perez galdos", "Teatro Pérez Galdós"),
    ("sala insular de teatro", "Sala Insular de Teatro"),
    ("auditorio alfredo kraus", "Auditorio Alfredo Kraus"),
    ("auditorio a. kraus", "Auditorio Alfredo Kraus"),
    ("auditorio kraus", "Auditorio Alfredo Kraus"),
    ("alfredo kraus", "Auditorio Alfredo Kraus"),
    ("sala scala", "Sala Scala"),
    ("sala miller", "Sala Miller"),
    ("edificio miller", "Edificio Miller"),
    ("gran canaria arena", "Gran Canaria Arena"),
    ("cicca", "CICCA"),
    ("casa de colon", "Casa de Colón"),
    ("museo elder", "Museo Elder"),
    ("caam", "CAAM"),
    ("centro atlantico de arte", "CAAM"),
    ("gabinete literario", "Gabinete Literario"),
    ("casa africa", "Casa África"),
    ("paper club", "Paper Club"),
    ("the paper club", "The Paper Club"),
    ("canarias en vivo", "Canarias en Vivo"),
    ("la azotea", "La Azotea"),
    ("el sotano", "El Sótano"),
    ("parque santa catalina", "Parque Santa Catalina"),
    ("parque san telmo", "Parque San Telmo"),
    ("parque doramas", "Parque Doramas"),
    ("plaza de la musica", "Plaza de la Música"),
    ("plaza de las ranas", "Plaza de las Ranas"),
    ("campus del obelisco", "Campus del Obelisco"),
    ("campus obelisco", "Campus del Obelisco"),
    ("facultad de humanidades", "Facultad de Humanidades ULPGC"),
    ("estadio de gran canaria", "Estadio de Gran Canaria"),
    ("estadio gran canaria", "Estadio de Gran Canaria"),
    ("infecar", "INFECAR"),
    ("recinto ferial", "Recinto Ferial INFECAR"),
    ("centro penitenciario", "Centro Penitenciario Las Palmas"),
    ("palmitos park", "Palmitos Park"),
    ("aqualand", "Aqualand Maspalomas"),
    ("holidayworld", "HolidayWorld Maspalomas"),
]
VENUE_DOMAINS = [
    ("teatroperezgaldos.es", "Teatro Pérez Galdós"),
    ("auditorioalfredokraus.es", "Auditorio Alfredo Kraus"),
    ("teatroguiniguada.es", "Teatro Guiniguada"),
    ("cicca.es", "CICCA"),
    ("teatrocuyas.com", "Teatro Cuyás"),
    ("salaescala.com", "Sala Scala"),
    ("salamiller.es", "Sala Miller"),
    ("grancanariaarena.com", "Gran Canaria Arena"),
]

# Scope of the island: accepted and rejected words in a location text.
ISLAND_WORDS = [
    "las palmas", "gran canaria", "telde", "arucas", "gáldar", "galdar", "agüimes",
    "aguimes", "ingenio", "santa lucía", "santa lucia", "san bartolomé",
    "san bartolome", "mogán", "mogan", "teror", "firgas", "valsequillo", "tejeda",
    "artenara", "agaete", "moya", "guía", "guia", "santa brígida", "santa brigida",
    "vega de san mateo", "valleseco", "maspalomas", "playa del inglés",
    "playa del ingles", "vecindario", "puerto rico", "arguineguín", "arguineguin",
    "arinaga", "el puertillo", "tarajalillo", "infecar", "gc arena", "sala faro",
    "canarias en vivo", "imaginario", "paraninfo", "sotano analogico",
    "la juntadera", "taurito",
]
OTHER_PLACES = [
    "tenerife", "lanzarote", "fuerteventura", "la palma", "la gomera", "el hierro",
    "arrecife", "adeje", "la laguna", "santa cruz de tenerife",
    "diferentes ciudades",
]
SLUG_ACCEPT = [
    "las-palmas", "gran-canaria", "canarias-en-vivo", "telde", "vecindario",
    "arucas", "agaete", "maspalomas", "ingenio", "aguimes",
]
SLUG_REJECT = [
    "sevilla", "madrid", "barcelona", "valencia", "bilbao", "granada", "malaga",
    "cordoba", "cadiz", "murcia", "alicante", "castellon", "tenerife", "lanzarote",
    "fuerteventura", "la-palma", "la-gomera", "el-hierro", "arrecife", "adeje",
    "la-laguna",
]
VENUE_REJECT = [
    "tenerife", "lanzarote", "fuerteventura", "la palma", "la gomera", "el hierro",
    "arrecife", "adeje", "la laguna", "santa cruz de tenerife", "sevilla", "madrid",
    "barcelona", "valencia",
]

# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------
# (part of the host name, source code); first match wins.
HOST_CODES = [
    ("tomaticket", "tomaticket"), ("auditorioalfredokraus", "auditorio"),
    ("teatroperezgaldos", "teatro_galdos"), ("guiniguada", "guiniguada"),
    ("gobiernodecanarias", "guiniguada"), ("fundacionlacajadecanarias", "cicca"),
    ("tickety", "tickety"), ("ticketmaster", "ticketmaster"), ("janto", "janto"),
    ("entrees", "entrees"), ("entradascanarias", "entradascanarias"),
    ("entradas.com", "entradas_com"), ("teldecultura", "teldecultura"),
    ("salanproducciones", "salanproducciones"),
]
DEFAULT_HOST_CODE = "generico"
PAGE_VENUE_CODES = [("tomaticket", "tomaticket"), ("tickety", "tickety")]
TICKET_URL_TOKENS = [
    "tickety", "tomaticket", "entrees", "entradas.com", "ticketmaster", "compra",
    "tureservaonline",
]
LINK_NOISE_PARTS = ["/category/", "/tag/", "/author/", "/page/"]
SOURCE_SCORES = [
    ("Ticketmaster", 100), ("EntradasCanarias", 90), ("Tickety", 80),
    ("Tomaticket", 70), ("CICCA", 65), ("Teatro Guiniguada", 65),
    ("Entrées.es", 40), ("CanariasEnVivo", 35),
]
DEFAULT_SOURCE_SCORE = 50
SOURCE_PRIORITIES = [
    ("Auditorio A. Kraus", 1), ("Teatro Pérez Galdós", 2), ("CICCA", 3),
    ("Teatro Guiniguada", 4), ("Ticketmaster", 5), ("Tomaticket", 6), ("Tickety", 7),
]
DEFAULT_SOURCE_PRIORITY = 99
EXPECTED_SOURCES = [
    "Ticketmaster", "Auditorio A. Kraus", "Teatro Pérez Galdós", "CICCA",
    "Teatro Guiniguada", "Tomaticket", "Tickety", "Entradas.com", "Entrées.es",
    "EntradasCanarias", "TeldeCultura", "Salan Producciones", "LocalGuideGC",
    "CanariasEnVivo", "Entradium",
]
EVENT_TYPES = ["Event", "MusicEvent", "TheaterEvent", "Festival"]
ARTICLE_TYPES = ["Article", "BlogPosting"]
GRAPH_ARTICLE_TYPES = ["Article", "BlogPosting", "WebPage"]

# Export column names.
EXPORT_COLUMNS = {
    "nombre": "Evento", "lugar": "Lugar", "fecha_iso": "Fecha", "hora": "Hora",
    "precio_num": "Precio (€)", "estilo": "Categoría", "organiza": "Fuente",
    "url_venta": "URL", "imagen_url": "Imagen", "descripcion": "Descripción",
    "ver_mapa": "Ver en Mapa", "merged_from_sources": "Fuentes Combinadas",
}

# --------------------------------------------------------------------------
# thresholds
# --------------------------------------------------------------------------
TITLE_MATCH_SCORE = 82
TABLE_MATCH_SCORE = 90
SESSION_GAP_MINUTES = 120
NO_HOUR = -999
PAGE_SIZE = 18
WINDOW_DAYS = 90
RSS_ITEMS = 50
SITEMAP_SHARD = 50_000
SEARCH_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
SPANISH_STOP_WORDS = [
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por",
    "un", "para", "con", "no", "una", "su", "al", "lo", "como", "más", "pero",
    "sus", "le", "ya", "o", "este", "sí", "porque", "esta", "entre", "cuando",
    "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde", "quien",
]
# Also left out of the words of a query, and of the checks of searches by words; an index keeps them.
QUERY_STOP_WORDS = [
    *SPANISH_STOP_WORDS,
    "desde", "todo", "nos", "durante", "todos", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante",
    "ellos", "e", "esto", "mí", "antes", "algunos", "qué", "unos", "yo", "otro", "otras", "otra", "él", "tanto",
    "esa", "estos", "mucho", "quienes", "nada", "muchos", "cual", "poco", "ella", "estar", "estas", "algunas",
    "algo", "nosotros", "mi", "mis", "tú", "te", "ti", "tu", "tus", "ellas", "nosotras", "vosotros", "vosotras",
    "os", "mío", "mía", "míos", "mías", "tuyo", "tuya", "tuyos", "tuyas", "suyo", "suya", "suyos", "suyas",
    "nuestro", "nuestra", "nuestros", "nuestras", "vuestro", "vuestra", "vuestros", "vuestras", "esos", "esas",
]

# Starter keyword table (category, keywords).  It is a parameter: the full vocabulary
# of a deployment is a table, see ``sources.listings.read_keywords`` and ``lookups.classify_by_table``.
STARTER_KEYWORDS = [
    ("Música", ["concierto", "concert", "festival", "música", "rock", "jazz", "orquesta"]),
    ("Teatro", ["teatro", "obra", "escena", "monólogo", "compañía", "zarzuela"]),
    ("Cine", ["cine", "película", "film", "cortometraje", "documental"]),
    ("Danza", ["danza", "ballet", "baile", "tango"]),
    ("Humor", ["humor", "comedia", "monólogo", "stand up"]),
    ("Gastronomía", ["cocina", "cata", "vino", "cerveza", "tapas"]),
    ("Deporte", ["deporte", "carrera", "torneo", "yoga", "liga"]),
    ("Infantil", ["infantil", "familiar", "títeres", "cuentacuentos"]),
    ("Formación", ["taller", "curso", "charla", "conferencia", "debate"]),
    ("Exposición", ["exposición", "muestra", "museo", "pintura"]),
    ("Carnaval", ["carnaval", "murga", "comparsa", "gala"]),
    ("Fiesta", ["fiesta", "party", "verbena", "club"]),
]
