"""Keyword, pattern and user-agent expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first keyword found names the class.
BANK_CLASSES = {
    "bancorp": "bancorp", "sutton": "sutton", "stride": "stride", "wells fargo": "wells_fargo",
    "chase": "chase", "bank of america": "bank_of_america",
}
RESIDENCE_CLASSES = {"rent": "rent", "own": "own"}
EMPLOYMENT_CLASSES = {"full": "full_time", "benefit": "benefit", "pension": "benefit", "part": "part_time"}
DEVICE_CLASSES = {
    "iphone": "apple_mobile", "android": "not_apple_mobile", "macintosh": "apple_desktop",
    "windows": "not_apple_desktop", "x11": "not_apple_desktop", "ipad": "apple_tablet",
}

# Any-of patterns, matched without regard to case.
BANK_FLAGS = {
    "is_fintech_bank": "chime|cash app|gobank|netspend|varo|dave|current|revolut|monzo|sofi|ally|greendot|green dot",
    "is_credit_union": "credit union| fcu| cu",
}
EMPLOYER_FLAGS = {
    "is_employer_walmart": "wal.*mart|walmart",
    "is_employer_usps": "usps|postal service",
    "is_employer_fedex": "fed.*ex|fedex",
    "is_employer_doordash": "door.*dash|doordash",
    "is_self_employed_agg": "self|1099|freelance|independent contractor|business owner",
    "is_fixed_income_benefits": "retired|retirement|ssa|ssi|disability|socsec|social security|benefits|va benefits",
    "is_public_assistance_afdc": "afdc|child support",
    "is_non_working_text": "homemaker|home maker|housewife|house wife|student|unknown|none|noemployer",
    "is_toxic_employer_tier": "cracker barrel|taco bell|burger king|dennys|holiday inn|dunkin|waffle house|popeyes|jack in the box|^irs$",
    "is_elite_low_risk_employer": "publix|costco|macy|meijer|cvs pharmacy|general motors|bank of america|allied universal|securitas|goodwill",
}

# The fifty states.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()


def keyword_class(text: Column, classes: dict[str, str], default: str = "others") -> Column:
    low = F.lower(text)
    out = None
    for word, name in classes.items():
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def pattern_flag(text: Column, pattern: str) -> Column:
    """1 if the pattern occurs, ignoring case; 0 otherwise and for null. Dots stay on one line."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)).cast("int")


def pattern_flags(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """One flag per pattern; spaces around the text don't count."""
    return {name: pattern_flag(F.trim(text), p) for name, p in patterns.items()}


def state_code(text: Column) -> Column:
    """Upper-cased first two characters when they name a state, else 'others'."""
    code = F.upper(F.substring(text, 1, 2))
    return F.when(code.isin(US_STATES), code).otherwise(F.lit("others"))


def first_char(code: Column, null_as: str | None = None) -> Column:
    text = code.cast("string")
    return F.substring(text if null_as is None else F.coalesce(text, F.lit(null_as)), 1, 1)


def extract(text: Column, pattern: str) -> Column:
    """First capture group; null when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


PLATFORM_PATTERN = r"\(([^;]+);"


def clean_string(text: Column) -> Column:
    """Trimmed, upper case; spellings of 'missing' become null."""
    # Spellings of missing.
    t = F.upper(F.trim(text))
    return F.when(~t.isin("", "NAN", "NONE", "NULL", "N/A", "UNKNOWN"), t)


def id_as_string(value: Column) -> Column:
    """Text of an id without the '.0' a float detour leaves behind."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def combo(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def _select(cases: list[tuple[Column, str]], default: Column) -> Column:
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def user_agent_columns(agent: Column) -> dict[str, Column]:
    """Device, system, traffic source, iOS age, hardware tier and their combinations."""
    ua = F.coalesce(agent, F.lit("unknown"))

    def has(p):
        return ua.rlike(f"(?i){p}")

    device = _select(
        [
            (has("Mobile|iPhone"), "Mobile"),
            (has("Tablet|iPad|Android(?!.*Mobile)"), "Tablet"),
            (has("Windows NT|Macintosh|X11"), "Desktop"),
        ],
        F.lit("Unknown_Device"),
    )
    system = _select(
        [
            (has("iPhone|iPad|iPod"), "iOS"),
            (has("Android"), "Android"),
            (has("Windows"), "Windows"),
            (has("Mac OS X|Macintosh") & ~has("iPhone|iPad"), "Mac"),
        ],
        F.lit("Other/Unknown"),
    )
    browser = _select(
        [
            (has("Edg"), "Edge"),
            (has("SamsungBrowser"), "Samsung_Internet"),
            (has("Chrome|CriOS"), "Chrome"),
            (has("Firefox|FxiOS"), "Firefox"),
            (has("Safari") & ~has("Chrome|CriOS|Edg|Samsung"), "Safari"),
        ],
        F.lit("Unknown_Browser"),
    )
    source = _select(
        [
            (has("FBAV|FBAN|FBIOS"), "Facebook_App"),
            (has("Instagram"), "Instagram_App"),
            (has("Snapchat"), "Snapchat_App"),
            (has("TikTok|Musical_ly"), "TikTok_App"),
            (ua.rlike(r" wv\)"), "Generic_InApp"),
        ],
        browser,
    )
    version = extract(ua, r"CPU iPhone OS (\d+(?:_\d+)?)")
    version = F.replace(version, F.lit("_"), F.lit(".")).try_cast("double")
    ios_age = _select(
        [
            ((system == "iOS") & (version < 17.0), "Old_Legacy_iOS"),
            ((system == "iOS") & (version >= 17.0), "Modern_iOS"),
        ],
        F.lit("Not_iOS"),
    )
    tier = hardware_tier(extract(ua, r"FBDV/(iPhone\d+,\d+)"))
    return {
        "device_type": device,
        "os_family": system,
        "traffic_source": source,
        "ios_device_age_proxy": ios_age,
        "iphone_wealth_tier": tier,
        "device_browser_combo": combo(device, source),
        "os_source_combo": combo(system, source),
    }


def hardware_tier(code: Column) -> Column:
    """Tier from the major number of a hardware code such as 'iPhone11,8'."""
    major = F.regexp_extract(code, r"iPhone(\d+),", 1).try_cast("int")
    return (
        F.when(major <= 12, "Older_Budget_iPhone")
        .when(major.isin(13, 14), "Mid_Tier_iPhone")
        .when(major >= 15, "Premium_New_iPhone")
        .otherwise("Not_Detected")
    )
