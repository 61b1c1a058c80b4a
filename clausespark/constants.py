"""Word lists, patterns, weights and limits that results depend on."""

from __future__ import annotations

# ---- fixed values: patterns -------------------------------------------------
# Whitespace as str.split() sees it, written so Java and RE2 agree.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
TOKEN = r"[0-9A-Za-z\x{400}-\x{4FF}']+"
TOKEN_CHARS = r"[0-9A-Za-z\x{400}-\x{4FF}']"
LATIN_WORD = r"[a-zA-Z']+"
DOC_CODE = r"\b(shnq|qmq|kmk|snip)\s*([0-9][0-9.\-]*)\b"
TITLE_DOC_CODE = r"\b(SHNQ|QMQ|KMK|SNIP)\s+([0-9][0-9.\-]*)\b"
CLAUSE_REF = (
    r"(?:\b(?:band|modda)(?:i|lar|da|ni|ga|dan|ning)?\s*[-.:]?\s*(\d+(?:\.\d+){0,3})\b|"
    r"\b(\d+(?:\.\d+){0,3})\s*[-.:]?\s*(?:band|modda)(?:i|lar|da|ni|ga|dan|ning)?\b)"
)
BARE_CLAUSE = r"\b(\d+\.\d+(?:\.\d+){0,2})\b"
TABLE_REF = (
    r"(?:\bjadval(?:da|ni|ga|dan|ning|lar)?\s*[-.]?\s*(\d+(?:\.\d+)*[a-z]?)\b|"
    r"\b(\d+(?:\.\d+)*[a-z]?)\s*[-.]?\s*jadval(?:da|ni|ga|dan|ning|lar)?\b)"
)
APPENDIX_REF = (
    r"(?:\b(\d+)\s*[-.]?\s*ilova(?:si|da|ga|dan|ning|lar)?\b|"
    r"\bilova(?:si|da|ga|dan|ning|lar)?\s*[-.]?\s*(\d+)\b)"
)
CHAPTER_REF = r"(?:\bbob\s*[-.:]?\s*(\d+(?:\.\d+)*)\b|\b(\d+(?:\.\d+)*)\s*[-.:]?\s*bob\b)"
TABLE_WORD = r"\b(jadval|jadvl|jadvlda|jdval|table|ilova|appendix)\b"
CLAUSE_LOOKUP = (
    r"(?:\b\d+\s*[-.]?\s*band(?:da|ni|ga|dan|ning|lar)?\b|\bband(?:da|ni|ga|dan|ning|lar)?\b|\bmodda\b)"
)
GREETING = r"\bsalom\b|\bassalomu?\s+alaykum\b|\bva\s*alaykum\s+assalom\b|\bhello\b|\bhi\b"
VALUE_UNIT = r"(\d+(?:[.,]\d+)?)\s*(mm|sm|cm|m|metr(?:i|a|)?|meter|metre|foiz|%)\b"
LEADING_NUMBER = r"^(\d{1,3}(?:\.\d{1,3})*)\s*[\).:-]?\s*"
TABLE_LABEL_A = r"\bjadval\s*[-.]?\s*([0-9]+[a-z]?)\b"
TABLE_LABEL_B = r"\b([0-9]+[a-z]?)\s*[-.]?\s*jadval\b"
IMAGE_URL = r"\bURL:\s*(https?://\S+)"
SENTENCE_END = r"[.!?](?:\s|$)"
SHORT_ANSWER_LABEL = r"(?:qisqa qilib aytganda:|in short:)"
CLASSIC_MOJIBAKE = "(?:Рљ|РІР|Р вЂ|РїВ|Г[ѐё])"
APOSTROPHE_MOJIBAKE = "К[»јї°±Ёё]"
# Every damaged fragment starts with one of these.
MOJIBAKE_LEADS = "РГК"

APOSTROPHES = "`’‘ʼʻ′"

# ---- fixed values: word lists -----------------------------------------------
SUFFIXES = (
    "larining", "laridan", "larida", "lariga", "larini", "larning", "lardan", "sigacha",
    "igacha", "sidan", "idan", "gacha", "lari", "ning", "dagi", "dan", "lar", "gan",
    "si", "ga", "da", "ni", "i",
)
PRIORITY_STOPWORDS = (
    "aholi", "punkt", "punktlar", "punktlari", "turar", "joy", "bino", "binolar", "hudud",
    "hududlar", "minimal", "maksimal", "kamida", "kopi", "ko'pi", "ulush", "foiz", "masofa",
    "norma", "meyor", "me'yor", "talab", "qancha", "necha", "kerak", "bo'lish", "bolish",
    "band", "bob", "hujjat",
)
QUERY_STOPWORDS = (
    "uchun", "bilan", "qanday", "qaysi", "nima", "emas", "keltirilgan", "berilgan", "bo'lgan",
    "bolgan", "shnq", "qmq", "kmk", "snip", "larda", "larda?",
)
SPECIFICITY_STOPWORDS = (
    "minimal", "maksimal", "kamida", "ko'pi", "foiz", "ulush", "qancha", "necha", "kerak",
    "talab", "norma", "me'yor", "meyor", "hujjat", "band", "bob",
)
ANCHOR_STOPWORDS = SPECIFICITY_STOPWORDS + (
    "aholi", "punkt", "punktlar", "punktlari", "turar", "joy", "bino", "binolar", "hudud",
    "hududlar", "masofa", "bo'lish", "bolish",
)
TABLE_CONTEXT_STOPWORDS = (
    "jadval", "jadvlda", "jadvl", "jdval", "table", "ilova", "appendix", "haqida", "malumot",
    "ma'lumot", "nima", "deyilgan", "ber", "bering", "korsat", "ko'rsat", "qaysi", "boyicha",
    "bo'yicha", "shnq", "qmq", "kmk", "snip",
)
TABLE_GENERIC_TERMS = ("jadval", "table", "satr", "ustun", "ilova", "appendix")
DOMAIN_KEYWORDS = (
    "shnq", "qmq", "kmk", "snip", "qurilish", "me'yor", "meyor", "norma", "band", "bob", "hujjat",
)
OUT_OF_SCOPE_KEYWORDS = (
    "python", "javascript", "react", "nextjs", "fastapi", "django", "sport", "music", "kino", "weather",
)
TABLE_HINTS = ("jadval", "table", "ilova", "appendix")
TABLE_QUESTION_HINTS = (
    "nima", "qanday", "qancha", "necha", "qaysi", "izoh", "tushuntir", "hisobla", "ber", "kerak",
)
ROW_FOCUS_TERMS = (
    "deraza", "eshik", "lift", "fasad", "tom", "issiqlik", "material", "rang", "o'lcham", "quvvat", "talab",
)
NUMERIC_REQUIREMENT_HINTS = (
    "minimal", "maksimal", "kamida", "ko'pi", "masofa", "foiz", "ulush", "norma", "me'yor", "meyor",
    "qancha", "necha",
)
DOCUMENT_LIST_PHRASES = ("qaysi shnq", "qaysi hujjat", "qaysi norma", "qaysi normativ")
ROW_TABLE_TERMS = ("jadval", "satr", "ustun", "table", "ilova")
ROW_QUESTION_TERMS = ("qaysi", "qanday", "keltirilgan", "berilgan", "talab")
COMPARE_TERMS = ("taqqos", "solishtir", "farq", "difference", "compare")
INTENT_TABLE_TERMS = ("jadval", "table", "satr", "ustun", "ilova", "appendix")
IMAGE_TERMS = ("rasm", "image", "diagramma", "sxema", "surat", "chizma")
BAND_TERMS = ("band", "modda", "bob")
MIN_TERMS = ("minimal", "eng kam", "kamida", "kam bo'lmasligi", "at least")
MAX_TERMS = ("maksimal", "eng ko'p", "ko'pi bilan", "ortiq bo'lmasligi", "at most")
EXACT_TERMS = ("aniq", "teng", "exact")
NUMERIC_QUESTION_TERMS = ("qancha", "necha", "qanday", "qiymat", "talab", "bo'lishi kerak")
PROPERTY_ALIASES = {
    "kenglik": ("kenglik", "kengligi", "kenglig"),
    "balandlik": ("balandlik", "balandligi", "balandlig"),
    "masofa": ("masofa", "masofasi", "masof"),
    "uzunlik": ("uzunlik", "uzunligi", "uzunlig"),
    "qalinlik": ("qalinlik", "qalinligi", "qalinlig"),
    "foiz": ("foiz", "foizi"),
    "diametr": ("diametr", "diametri"),
    "radius": ("radius", "radiusi"),
    "yuzasi": ("yuzasi", "yuzas"),
    "hajm": ("hajm", "hajmi"),
}
MIN_HINTS = ("kamida", "minimal", "eng kam")
MAX_HINTS = ("maksimal", "ko'pi bilan", "eng ko'p")
SYNONYMS = {
    "ko'kalamzor": ("yashil hudud", "yashil maydon", "ko'kalamzor hudud"),
    "ko'kalamzorlashtiril": ("yashil hudud", "yashil maydon", "ko'kalamzor hudud"),
    "ulush": ("foiz", "maydon ulushi"),
    "hojatxona": ("tualet", "hovli tualeti", "tashqi hojatxona"),
    "hovli": ("tomorqa", "uy oldi hududi"),
    "turar joy": ("uy", "yashash binosi"),
}
QUALITY_TERMS = (
    "kerak", "lozim", "mumkin", "taqiqlanadi", "kamida", "ko'pi", "maksimal", "minimal", "foiz",
    "metr", "mm", "sm", "jadval", "talab",
)
UZ_HINTS = (
    "va", "uchun", "qanday", "qaysi", "nima", "necha", "kerak", "bu", "shu", "ham", "emas", "mumkin",
    "lozim", "bo'yicha", "bilan", "yoki", "hujjat", "band", "bandda", "jadval", "masofa", "masofani",
    "balandlik", "kenglik", "qazish", "taqiqlanadi", "yozilgan", "qilinadi", "ortiq", "past",
    "tomonga", "qurilish", "me'yor", "talab",
)
EN_HINTS = (
    "what", "which", "where", "when", "why", "how", "is", "are", "be", "the", "and", "or", "for",
    "with", "in", "of", "to", "from", "by", "on", "at", "shall", "must", "required", "minimum",
    "maximum", "distance", "depth", "height", "width", "requirements", "fire", "safety",
)
UZ_APOSTROPHE_MARKS = ("o'", "g'", "o`", "g`")
SELECTION_MARKERS = ("shu", "tanla", "tanladim", "kerak", "mana", "yubor", "yuboryapman")
NO_ANSWER_MARKERS = ("topilmadi", "aniq javob topilmadi", "yetarli dalil topilmadi", "no clear answer")
AMBIGUOUS_PROMPT = "savolda bir nechta hujjatda mos variant topildi"
SELECTION_PROMPTS = (
    "aynan qaysi shnq", "qaysi shnq nazarda", "qaysi hujjat nazarda", "quyidagi shnq hujjatlarida",
)
ACTIVE_JOB_STATUSES = ("queued", "running")

# ---- fixed values: limits and weights ---------------------------------------
MIN_TEXT_LEN = 30
HASH_DIM = 384
TOP_K = 8
MIN_SCORE = 0.15
STRICT_MIN_SCORE = 0.24
DENSE_K = 24
LEXICAL_K = 24
FINAL_K = 10
RRF_K = 60
RERANK_CANDIDATES = 40
KEYWORD_WEIGHT = 0.15
ROW_TOP_K = 5
ROW_INTENT_TOP_K = 8
ROW_MIN_SCORE = 0.16
RICH_CLAUSE_THRESHOLD = 0.42
IMAGE_TOP_K = 3
IMAGE_MIN_SCORE = 0.22
OTHER_IMAGE_FLOOR = 0.30
TRANSLATION_THRESHOLD = 0.35
TRANSLATED_WEIGHT = 0.97
AMBIGUITY_GAP = 0.03
AMBIGUITY_MAX_DOCS = 6
LOW_CONFIDENCE_FLOOR = 0.12
NEAR_STRICT_MARGIN = 0.03
DOMINANCE_RATIO = 0.8
STRONG_KEYWORD = 0.3
DOMINANCE_WINDOW = 5
ROUTE_TOP_K = 3
ROUTE_DENSE_K = 50
ROUTE_MIN_SCORE = 0.12
ROUTE_CLOSE_RATIO = 0.9
ROUTE_LOW_CONFIDENCE = 0.22
DUPLICATE_SIM = 0.9
DEEP_MULTIPLIER = 2
NUMERIC_WEIGHT = 0.24
NUMERIC_RESCUE_MIN = 0.08
CACHE_MIN_SCORE = 0.9
REJECTED_NEAR_FLOOR = 0.92
STALE_DOC_MINUTES = 15
STALE_JOB_MINUTES = 10
JOB_PAGE = 50
UNNUMBERED_TITLE = "Band -"
CONTEXT_ITEMS = 18
CLAUSE_EXCERPT = 850
TABLE_EXCERPT = 1400
GUEST_LIMIT = 3

# What to offer when several tables bear one number.
CHOICE_DOCUMENTS = 7
CHOICE_CHAPTERS = 6
UNKNOWN_CHAPTER = "Noma'lum bob"
