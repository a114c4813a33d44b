"""Fixed values that decide results: lists, tables, patterns and limits."""

from __future__ import annotations

# --- Fixed values: regions -------------------------------------------------

# Weather region key -> location asked for.
REGION_LOCATIONS = {
    "Kyiv_Oblast": "Kyiv, Ukraine",
    "Kharkiv_Oblast": "Kharkiv, Ukraine",
    "Odesa_Oblast": "Odesa, Ukraine",
    "Lviv_Oblast": "Lviv, Ukraine",
    "Vinnytsia_Oblast": "Vinnytsia, Ukraine",
    "Dnipropetrovska_Oblast": "Dnipro, Ukraine",
    "Donetsk_Oblast": "Donetsk, Ukraine",
    "Zhytomyr_Oblast": "Zhytomyr, Ukraine",
    "Zaporizhzhia_Oblast": "Zaporizhzhia, Ukraine",
    "Ivano-Frankivsk_Oblast": "Ivano-Frankivsk, Ukraine",
    "Kirovohradska_Oblast": "Kropyvnytskyi, Ukraine",
    "Luhansk_Oblast": "Luhansk, Ukraine",
    "Volyn_Oblast": "Lutsk, Ukraine",
    "Mykolaiv_Oblast": "Mykolaiv, Ukraine",
    "Poltava_Oblast": "Poltava, Ukraine",
    "Rivne_Oblast": "Rivne, Ukraine",
    "Sumy_Oblast": "Sumy, Ukraine",
    "Ternopil_Oblast": "Ternopil, Ukraine",
    "Zakarpatska_Oblast": "Uzhhorod, Ukraine",
    "Kherson_Oblast": "Kherson, Ukraine",
    "Khmelnytskyi_Oblast": "Khmelnytskyi, Ukraine",
    "Cherkasy_Oblast": "Cherkasy, Ukraine",
    "Chernivtsi_Oblast": "Chernivtsi, Ukraine",
    "Chernihiv_Oblast": "Chernihiv, Ukraine",
    "Crimea": "Simferopol, Ukraine",
}

# Map shape name -> region id used by the serving tables.
SHAPE_REGIONS = {
    "Kherson Oblast": "kherson",
    "Volyn Oblast": "volyn",
    "Rivne Oblast": "rivne",
    "Zhytomyr Oblast": "zhytomyr",
    "Kyiv Oblast": "kyiv_oblast",
    "Chernihiv Oblast": "chernihiv",
    "Sumy Oblast": "sumy",
    "Kharkiv Oblast": "kharkiv",
    "Luhansk Oblast": "luhansk",
    "Donetsk Oblast": "donetsk",
    "Zaporizhia Oblast": "zaporizhzhia",
    "Lviv Oblast": "lviv",
    "Ivano-Frankivsk Oblast": "ivano_frankivsk",
    "Zakarpattia Oblast": "zakarpattia",
    "Ternopil Oblast": "ternopil",
    "Chernivtsi Oblast": "chernivtsi",
    "Odessa Oblast": "odesa",
    "Mykolaiv Oblast": "mykolaiv",
    "Autonomous Republic of Crimea": "crimea",
    "Vinnytsia Oblast": "vinnytsia",
    "Khmelnytskyi Oblast": "khmelnytskyi",
    "Cherkasy Oblast": "cherkasy",
    "Poltava Oblast": "poltava",
    "Dnipropetrovsk Oblast": "dnipropetrovsk",
    "Kirovohrad Oblast": "kirovohrad",
    "Kyiv (city)": "kyiv_city",
    "Sevastopol": "sevastopol",
}

EXPECTED_REGIONS = 25

# --- Fixed values: alarms --------------------------------------------------

FIRST_DAY = "2022-02-24"
ALARM_UPPER_BOUND = "2025-03-02"
MAX_ALARM_HOURS = 100
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
KNOWN_DATES = ["2022-02-24", "2022-08-24", "2022-10-10", "2024-07-08"]
SUSPECT_WORDS = ["test", "fake", "bonus"]
HORIZONS = [1, 3, 6, 12]
LEVEL_BANDS = [(0.80, "critical"), (0.60, "high"), (0.40, "medium"), (0.20, "low")]
LEVEL_DEFAULT = "safe"
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]

# --- Fixed values: weather -------------------------------------------------

EXPECTED_HOURS = 24
RANGES = {
    "temp": (-50.0, 50.0),
    "humidity": (0.0, 100.0),
    "windspeed": (0.0, 200.0),
    "pressure": (870.0, 1084.0),
    "cloudcover": (0.0, 100.0),
    "visibility": (0.0, 50.0),
}
REQUIRED_HOURLY = ["hour_temp", "hour_humidity", "hour_windspeed", "hour_pressure", "hour_cloudcover"]
LATITUDE = (44.0, 53.0)
LONGITUDE = (22.0, 41.0)
DAY_TOLERANCE = 0.5
HOURLY_FIELDS = [
    "hour_datetime", "hour_temp", "hour_feelslike", "hour_humidity", "hour_dew", "hour_precip",
    "hour_precipprob", "hour_snow", "hour_snowdepth", "hour_preciptype", "hour_windgust",
    "hour_windspeed", "hour_winddir", "hour_pressure", "hour_visibility", "hour_cloudcover",
    "hour_conditions",
]
DAILY_FIELDS = [
    "day_datetime", "day_tempmax", "day_tempmin", "day_temp", "day_humidity", "day_precip",
    "day_windspeed", "day_pressure", "day_cloudcover", "day_visibility", "day_conditions",
]
FORECAST_FIELDS = [
    "datetime", "temp", "humidity", "windspeed", "winddir", "visibility", "cloudcover",
    "pressure", "precip", "conditions",
]
# Columns kept for the weather analysis.
WEATHER_MAIN = [
    "city_address", "hour_datetime", "hour_temp", "hour_humidity", "hour_precip", "hour_snow",
    "hour_windgust", "hour_windspeed", "hour_visibility", "hour_cloudcover", "hour_conditions",
]

# --- Fixed values: report text ---------------------------------------------

MIN_HTML_LENGTH = 500
MIN_TEXT_LENGTH = 200
VALIDATION_PHRASE = "assessment"
BLOCK_MARKERS = [
    "just a moment", "cf-browser-verification", "checking your browser", "cloudflare",
    "ray id", "enable javascript and cookies",
]
BLOCK_MARKER_WINDOW = 3000
REMOVED_TAGS = ["nav", "header", "footer", "script", "style", "noscript", "iframe", "svg", "form"]
NOISE_WORDS = [
    "menu", "sidebar", "social", "share", "related", "comment", "navigation", "breadcrumb",
    "search", "banner", "popup", "modal", "cookie", "newsletter", "subscribe", "advertisement",
    "ad-container", "footer", "toolbar",
]
# (tag, class) in order of preference; class None means any.
CONTENT_SELECTORS = [
    ("div", "field-item"), ("div", "entry-content"), ("div", "node-content"),
    ("article", None), ("div", "content"), ("main", None),
]
FOOTNOTE_HEADINGS = ["endnote", "footnote", "reference", "source"]
FOOTNOTE_HEADING_TAGS = ["h2", "h3", "h4", "p", "strong"]
FOOTNOTE_PARENTS = ["div", "section", "article"]
FOOTNOTE_MARK = r"\[\s*\d+\s*\]"

# Replaced one for one.
CHAR_REPLACEMENTS = {
    "\xa0": " ", "‒": "-", "–": "-",
    "‘": "'", "’": "'", "‚": "'",
    "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "•": " ", "‣": " ", "●": " ", "·": " ",
}
CHARS_REMOVED = ["\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\ufeff"]
CHAR_EXPANSIONS = {"—": " - ", "―": " - ", "…": "..."}

MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
# Report addresses in the order they are tried.
REPORT_URL_PATTERNS = [
    "https://www.understandingwar.org/backgrounder/russian-offensive-campaign-assessment-{month}-{day}-{year}",
    "https://www.understandingwar.org/research/russia-ukraine/russian-offensive-campaign-assessment-{month}-{day}-{year}",
    "https://www.understandingwar.org/analysis/russia-ukraine/russian-offensive-campaign-assessment-{month}-{day}-{year}",
    "https://www.understandingwar.org/backgrounder/russian-offensive-campaign-assessment-{month}-{day_padded}-{year}",
    "https://www.understandingwar.org/research/russia-ukraine/russian-offensive-campaign-assessment-{month}-{day_padded}-{year}",
    "https://www.understandingwar.org/backgrounder/russian-offensive-campaign-assessment-{month}-{day}-{year}-0",
    "https://www.understandingwar.org/backgrounder/russian-offensive-campaign-assessment-{month}-{day}",
]
BLOCKS_PER_TRIGGER = 3

# --- Fixed values: links ---------------------------------------------------

INTERNAL_DOMAINS = [
    "understandingwar.org", "www.understandingwar.org", "isw.pub", "www.isw.pub",
    "iswresearch.org", "www.iswresearch.org",
]
BLOCKED_DOMAINS = [
    "facebook.com", "www.facebook.com", "m.facebook.com",
    "instagram.com", "www.instagram.com",
    "tiktok.com", "www.tiktok.com",
    "linkedin.com", "www.linkedin.com",
]
NON_HTML_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "jpg", "jpeg", "png", "gif", "svg", "webp", "bmp",
    "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm",
    "zip", "rar", "7z", "tar", "gz", "csv", "xml", "rss",
]
NON_HTML_CONTENT_TYPES = [
    "application/pdf", "application/octet-stream", "image/", "video/", "audio/",
    "application/zip", "application/x-rar",
]
TELEGRAM_RESERVED = ["joinchat", "addstickers", "share", "invoice"]
X_DOMAINS = ["x.com", "twitter.com", "www.x.com", "www.twitter.com"]
X_RESERVED = ["i", "search", "explore", "home"]
X_PROFILE_RESERVED = ["i", "search", "explore", "home", "intent"]
MAX_RESPONSE_BYTES = 5_000_000
MAX_ATTEMPTS = 2
REQUEST_TIMEOUT_SECONDS = 15
DEAD_STATUSES = ["dead_link", "timeout", "connection_error", "error"]
TITLE_LIMIT = 200

# --- Our own default for the daily score (no word list is published) --------

ESCALATION_LEXICON = [
    "attack", "artillery", "drone", "escalation", "explosion", "missile", "mobilization",
    "offensive", "shelling", "strike",
]
