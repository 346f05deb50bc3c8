"""Every regular expression of the engine, in Java syntax.

`(?U)` makes \\d and \\s Unicode-aware. Scans of text nobody controls are written
so that one long run of characters cannot make them quadratic.
"""

# --- fixed values: personal-data formats ---------------------------------
ID_CARD = r"(?U)(?<!\d)\d{17}[\dXx](?!\d)|(?<!\d)\d{15}(?!\d)"
PHONE = r"(?U)(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d[-\s]?\d{4}[-\s]?\d{4}(?!\d)"
LANDLINE = r"(?U)(?<!\d)0\d{2,3}-\d{7,8}(?!\d)"
BANK_CARD = r"(?U)(?<!\d)\d{13,19}(?!\d)"
# The local part starts a run or follows the previous match (\G), so a long run
# without an @ is read once instead of once per character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MASKED_NAME = r"[一-龥](?:某某|某|[Xx×]{1,2})(?=[\s\S])"

# Redaction order, each with its placeholder.
REDACTIONS = [
    ("id", ID_CARD, "[身份证号]"),
    ("phone", PHONE, "[手机号]"),
    ("landline", LANDLINE, "[固定电话]"),
    ("bank", BANK_CARD, "[银行卡号]"),
    ("email", EMAIL, "[邮箱]"),
    ("name", MASKED_NAME, "[当事人]"),
]
# Kinds reported by a scan, in report order.
SCANS = [("身份证号", ID_CARD), ("手机号", PHONE), ("银行卡号", BANK_CARD), ("邮箱", EMAIL)]

# --- fixed values: facts read from article text --------------------------
AMOUNT = r"(?U)(\d+(?:[.,]\d+)?)\s*(万余?元|万|余?元)"
QUOTE = r'[“"]([^”"]{4,60})[”"]'
PAGE_DATE = r"(?U)(20\d{2})[-年/.](\d{1,2})[-月/.](\d{1,2})"
TOKEN = r"([一-龥]|[A-Za-z0-9]+)"

# --- html -----------------------------------------------------------------
COMMENT = r"(?s)<!--.*?-->"
RAW_ELEMENTS = r"(?is)<(script|style)(?=[\s/>]).*?</\1\s*>"
NOISE_ELEMENTS = r"(?is)<(script|style|nav|header|footer|aside|form|iframe)(?=[\s/>]).*?</\1\s*>"
TAG = r"<[/!?a-zA-Z][^>]*>"
H1 = r"(?is)<h1(?=[\s/>])[^>]*>(.*?)</h1\s*>"
TITLE = r"(?is)<title(?=[\s/>])[^>]*>(.*?)</title\s*>"
CONTAINER_TAGS = ["article", "main", "div", "section"]
# Start tags that end an open paragraph.
PARAGRAPH_ENDERS = ["h[1-6]", "ul", "ol", "dl", "table", "blockquote", "pre", "hr", "address"]
BLOCK_CUT = r"(?i)<(?=/?(?:" + "|".join([*CONTAINER_TAGS, "p", *PARAGRAPH_ENDERS]) + r")[\s/>])"
BLOCK_NAME = r"^<(/?[a-zA-Z0-9]+)"
FIRST_TAG = r"^<[^>]*>"
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

URL_HOST = r"^[^:]+://([^/?#]*)"
EDGE_SPACE = r"(?U)^\s++|(?<!\s)\s++\z"
